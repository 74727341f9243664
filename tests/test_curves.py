"""Metrics of overlapping groups from one ordering against metrics of each group alone."""

import random

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import targets as tg
from tickerloom.operators.metrics import binary_metrics, segment_metrics
from workload import q_models as qm


def table(spark, hot, rows=2500):
    rng = random.Random(11)
    out = []
    for i in range(rows):
        p = 0.5 if rng.random() < hot else rng.choice([rng.random(), 0.25, 0.75, 0.0, 1.0])
        y = [float(rng.random() < p) if rng.random() > 0.2 else None for _ in range(2)]
        out.append((i % 4, f"2020-01-{i % 28 + 1:02d}", f"S{i // 28}", rng.choice(["up", "down", None]), p if rng.random() > 0.05 else None, *y, "few" if i % 500 == 0 else "many"))
    return spark.createDataFrame(out, "fold long, date string, ticker string, regime string, probability double, a double, b double, g string").repartition(9)


def read(df, keys):
    return {tuple(r[k] for k in keys): {c: r[c] for c in df.columns} for r in df.collect()}


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


@pytest.mark.parametrize("hot", [0.0, 0.5, 1.0])
def test_groups_from_one_ordering(spark, hot):
    df = table(spark, hot)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a frequent value lies in several tasks
    try:
        labels = {c: (F.col(c).isNotNull().cast("int"), F.coalesce(c, F.lit(0.0))) for c in "ab"}
        scopes = [["g"], ["g", "fold"], ["g", "regime"]]
        for ties in ((), ("date", "ticker")):
            found = segment_metrics(df, ["g"], labels, "probability", scopes, "t", ties)
            for scope, one in zip(scopes, found):
                for c in "ab":
                    plain = read(binary_metrics(df.filter(" AND ".join(f"{k} IS NOT NULL" for k in scope)), scope, c, "probability"), scope)
                    own = read(one.filter(F.col("t") == c), scope)
                    assert set(own) == set(plain)
                    for k, row in plain.items():
                        assert all(close(own[k][x], v) for x, v in row.items()), (scope, c, k, own[k], row)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_targets_side_by_side_equal_targets_as_rows(spark):
    df = table(spark, 0.3).filter("g = 'many'")
    known = df.filter("probability IS NOT NULL AND coalesce(a, b) IS NOT NULL")
    entries = F.array(*[F.struct(F.lit(c).alias("target_id"), F.col(c).alias("actual")) for c in "ab"])
    long = df.select("fold", "date", "ticker", "regime", "probability", F.inline(entries)).filter("actual IS NOT NULL AND probability IS NOT NULL")
    shared = tg.Shared(known, {c: c for c in "ab"})
    tables = tg.curve_tables(shared)
    for keys, make in (
        (["target_id"], lambda x: tg.walk_forward_table(x, tables=tables if x is shared else None)),
        (["target_id", "regime"], lambda x: tg.regime_table(x, tables=tables if x is shared else None)),
        (["target_id", "fold"], tg.fold_calibration),
        (["target_id", "ticker"], lambda x: tg.bucket_rates(x, ["target_id", "ticker"])),
    ):
        a, b = (read(make(x), keys) for x in (long, shared))
        assert set(a) == set(b) and a
        for k, row in a.items():
            assert all(close(b[k][x], v) if isinstance(v, float) else b[k][x] == v for x, v in row.items()), (k, row, b[k])


def test_thirds_equal_row_numbers(spark):
    df = table(spark, 0.4).filter("probability IS NOT NULL AND a IS NOT NULL")
    own = read(segment_metrics(df, [], {"a": (F.lit(1), F.col("a"))}, "probability", [["fold"]], None, ["date", "ticker"])[0], ["fold"])
    plain = read(tg.bucket_rates(df.withColumn("actual", F.col("a")), ["fold"], 1), ["fold"])
    for k, row in plain.items():
        o = own[k]
        assert (o["top_n"], o["bottom_n"]) == (row["top_bucket_count"], row["bottom_bucket_count"])
        assert close(o["top_total"] / o["top_n"], row["top_bucket_positive_rate"]) and close(o["bottom_total"] / o["bottom_n"], row["bottom_bucket_positive_rate"])


def test_no_rows_and_one_row(spark):
    df = table(spark, 0.0).filter("a = 1")
    labels = {"a": (F.lit(1), F.col("a"))}
    assert segment_metrics(df.limit(0), [], labels, "probability", [["fold"]])[0].count() == 0
    one = segment_metrics(df.filter("probability IS NOT NULL").limit(1), [], labels, "probability", [[]], None, ["date", "ticker"])[0].first()
    assert (one.sample_count, one.top_n, one.bottom_n, one.roc_auc) == (1, 0, 1, None)


def test_predictions_are_not_repeated_for_each_target(spark, sf):
    predictions = qm._predictions(spark, sf, qm._targets(spark, sf))
    rows = predictions.rows
    assert rows.count() == rows.select("fold", "date", "ticker").distinct().count() > 0
