"""The shared ordering against plain windows, with heavy ties and skew."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickerloom.plans.ranking import _placed, end_thirds, quantile_points, with_positions, with_running_totals
from tickerloom.plans.storage import settle


def rows(n=3000, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        # A third of one group shares a single value; another group is tiny.
        value = 0.5 if rnd.random() < 0.35 else round(rnd.random(), 3)
        group = "big" if rnd.random() < 0.9 else "small"
        out.append((group, f"t{i:05d}", 19000 + rnd.randrange(40), value))
    return out + [("single", "t", 1, 0.1)]


def frame(spark):
    df = spark.createDataFrame(rows(), "g string, ticker string, day int, v double")
    return settle(df.withColumn("date", F.date_add(F.lit("1970-01-01"), F.col("day"))))


def test_positions_match_plain_windows(spark):
    df = frame(spark)
    ours = with_positions(df, "g", "v", ["date", "ticker"], ranks=True)
    w = Window.partitionBy("g")
    plain = df.select(
        "g", "ticker",
        F.row_number().over(w.orderBy("v", "date", "ticker")).cast("long").alias("pos"),
        (F.rank().over(w.orderBy("v")) + (F.count(F.lit(1)).over(Window.partitionBy("g", "v")) - 1) / 2).alias("avg_rank"),
        F.rank().over(w.orderBy("v")).cast("long").alias("min_rank"),
        F.count(F.lit(1)).over(w).alias("group_size"),
    )
    columns = ["g", "ticker", "pos", "avg_rank", "min_rank", "group_size"]
    assert sorted(ours.select(*columns).collect()) == sorted(plain.select(*columns).collect())


def test_positions_without_groups(spark):
    df = frame(spark)
    got = with_positions(df, [], "v", ["date", "ticker"]).orderBy("pos").select("ticker").collect()
    want = df.orderBy("v", "date", "ticker").select("ticker").collect()
    assert got == want


def test_quantiles_match_percentile(spark):
    df = frame(spark)
    ranked = with_positions(df, "g", "v", ["date", "ticker"])
    got = {r.g: r.edges for r in quantile_points(ranked, "g", "v", [0, 0.2, 0.5, 0.9, 1]).collect()}
    want = {r.g: r.e for r in df.groupBy("g").agg(F.expr("percentile(v, array(0, 0.2, 0.5, 0.9, 1))").alias("e")).collect()}
    for g in want:
        assert [round(x, 9) for x in got[g]] == [round(x, 9) for x in want[g]]


def test_running_totals(spark):
    df = frame(spark).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("g", "v", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("below_n"))
    for calendar_bound in (True, False):
        got = with_running_totals(df, "g", "v", ["n"], calendar_bound).select("g", "v", "below_n")
        assert sorted(got.collect()) == sorted(want.collect())


def test_hot_group_hot_value_and_shared_prefix_are_spread(spark):
    # one group, one value and one name prefix throughout
    df = settle(spark.range(6000).selectExpr("'g' AS g", "concat('same_prefix_', lpad(id, 9, '0')) AS ticker", "1.0D AS v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows end in one partition
    try:
        sizes = [r["count"] for r in _placed(df, ["g", "v", "ticker"]).groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 3000
    got = with_positions(df, "g", "v", ["ticker"], ranks=True)
    assert got.filter("pos <> CAST(substr(ticker, 13) AS INT) + 1 OR avg_rank <> 3000.5 OR min_rank <> 1 OR group_size <> 6000").count() == 0


def test_null_groups_are_groups(spark):
    df = settle(spark.createDataFrame([(None, "a", 2.0), (None, "b", 1.0), ("x", "c", 5.0)], "g string, t string, v double"))
    got = {(r.g, r.t): (r.pos, r.min_rank, r.group_size) for r in with_positions(df, "g", "v", ["t"], ranks=True).collect()}
    assert got == {(None, "a"): (2, 2, 2), (None, "b"): (1, 1, 2), ("x", "c"): (1, 1, 1)}


def test_stored_rows_are_compressed_columns(spark):
    from pathlib import Path

    from tickerloom.plans.storage import checkpoint_dir, stored

    def size():
        return sum(f.stat().st_size for f in Path(checkpoint_dir(spark).removeprefix("file:")).rglob("*") if f.is_file())

    df = frame(spark).withColumn("s", F.struct("v", F.lit(None).cast("double").alias("none")))
    start = size()
    out = stored(df)
    columns = size()
    assert out.schema.simpleString() == df.schema.simpleString() and sorted(out.collect(), key=str) == sorted(df.collect(), key=str)
    settle(df)
    assert (columns - start) * 2 < size() - columns


def test_thirds_match_plain_windows_and_order_few_rows(spark, monkeypatch):
    from tickerloom.functions.buckets import rank_bucket
    from tickerloom.plans import ranking

    df = frame(spark).withColumn("y", (F.crc32(F.col("ticker").cast("binary")) % 2).cast("int"))
    df = df.unionByName(df.limit(0)).unionByName(spark.createDataFrame([(None, "a", 1, 1.0, None, 1), (None, "b", 1, 0.0, None, 0)], df.schema))
    ordered = []
    monkeypatch.setattr(ranking, "with_positions", lambda d, *a, **k: ordered.append(d.count()) or with_positions(d, *a, **k))
    ours = end_thirds(df, "g", "v", ["date", "ticker"], "y")
    w = Window.partitionBy("g")
    plain = df.withColumn("b", rank_bucket(F.row_number().over(w.orderBy("v", "date", "ticker")), F.count(F.lit(1)).over(w), 3))
    top, bottom = F.col("b") == 2, F.col("b") == 0
    plain = plain.groupBy("g").agg(
        F.count_if(bottom).alias("bottom_n"), F.sum(F.when(bottom, F.col("y"))).alias("bottom_total"), F.count_if(top).alias("top_n"), F.sum(F.when(top, F.col("y"))).alias("top_total"),
    )
    assert set(ours.select(*plain.columns).collect()) == set(plain.collect()) and plain.count() == 4
    assert sum(ordered) < 0.5 * df.count()


def test_shared_probabilities_give_the_same_metrics(spark):
    from tickerloom.operators.metrics import binary_metrics

    df = frame(spark).filter("g <> 'single' OR day > 0")
    rows_of = [F.struct(F.lit(t).alias("t"), F.when(F.crc32(F.concat("ticker", F.lit(t)).cast("binary")) % k > 0, 1.0).otherwise(0.0).alias("y")) for t, k in (("a", 2), ("b", 3), ("c", 1))]
    long = settle(df.select("g", "ticker", "v", F.inline(F.array(*rows_of))).filter("t <> 'b' OR g <> 'small'"))
    for by in (["t"], ["t", "g"]):
        plain, shared = (binary_metrics(long, by, "y", "v", shared=s) for s in (None, "t"))
        rounded = [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in out.select(plain.columns).fillna(-1).collect()) for out in (plain, shared)]
        assert rounded[0] == rounded[1] and len(rounded[0]) == (3 if by == ["t"] else 8)
    assert binary_metrics(long.limit(0), ["t"], "y", "v", shared="t").count() == 0


def test_top_third_of_a_date_matches_a_plain_window_without_a_join_by_ticker(spark):
    from tickerloom.operators.labels import top_third_of_date

    df = frame(spark).filter("g <> 'single'").select("ticker", "date", F.when(F.col("v") < 0.95, F.col("v")).alias("x"), "g")
    df = settle(df.unionByName(spark.createDataFrame([("p", None, "q"), ("r", None, "q"), ("s", 1.0, "q")], "ticker string, x double, g string").withColumn("date", F.lit("1970-01-01").cast("date"))))
    out = top_third_of_date(df, "x", "y")
    w = Window.partitionBy("date")
    plain = df.filter("x IS NOT NULL").withColumn("n", F.count(F.lit(1)).over(w)).withColumn("p", F.row_number().over(w.orderBy("x", "ticker")))
    plain = plain.select("ticker", F.when(F.col("n") >= 3, (F.col("p") / F.col("n") > 2 / 3).cast("double")).alias("y"))
    assert dict(out.select("ticker", "y").collect()) == {r.ticker: None for r in df.collect()} | dict(plain.collect())
    assert out.columns == ["ticker", "date", "x", "g", "y"]
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
