"""Ranks within masks and the signal table against plain computations."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import audits as au
from tickerloom.plans import ranking
from tickerloom.plans.storage import checkpoint_dir

T, UP, DOWN = "forward_20d_excess_return", "label_outperform_20d", "label_drawdown_risk_20d"


def average_ranks(values):
    ordered = sorted(values)
    first, count = {}, {}
    for i, v in enumerate(ordered):
        first.setdefault(v, i + 1)
        count[v] = count.get(v, 0) + 1
    return [first[v] + (count[v] - 1) / 2 for v in values]


def pearson(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    cov, a, b = (sum((p - m) * (q - n) for p, q in zip(u, v)) for u, m, v, n in ((x, mx, y, my), (x, mx, x, mx), (y, my, y, my)))
    return cov / (a * b) ** 0.5 if a and b else None


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_mask_ranks_equal_plain_ranks(spark, hot):
    """A value that many rows share lies in several tasks."""
    rng = random.Random(5)
    rows = [(1.5 if rng.random() < hot else rng.choice([rng.random() * 3, -0.0, 0.0, 2.0]), rng.random() < 0.6, rng.random() < 0.1, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "v double, a boolean, b boolean, i int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {r.i: r for r in ranking.with_mask_ranks(df, "v", ["a", "b"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == len(rows)
    for k, m in ((1, "a"), (2, "b")):
        mine = [r for r in rows if r[k]]
        for row, rank in zip(mine, average_ranks([r[0] for r in mine])):
            assert out[row[3]][f"rank_{m}"] == rank
            assert out[row[3]][f"same_{m}"] == sum(r[0] == row[0] for r in mine)


def panel(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        x = rng.gauss(0, 1)
        t = round(x + rng.gauss(0, 2), 1) if rng.random() > 0.1 else None
        up = None if t is None else float(t > 0.2)
        down = float(rng.random() < 0.3) if rng.random() > 0.2 else None
        rows.append((x if rng.random() > 0.2 else None, round(x), 3.0, None, t, up, down))
    return spark.createDataFrame(rows, f"a double, b int, c double, nothing double, {T} double, {UP} double, {DOWN} double"), rows


def test_signal_equals_plain_computation_and_leaves_no_tables(spark):
    df, rows = panel(spark)
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = {r.feature: r for r in au.feature_signal(df, ["a", "b", "c", "nothing"]).collect()}
    assert not [f for f in set(os.listdir(folder)) - before if f.startswith("table-")]  # orderings are passing
    assert set(out) == {"a", "b", "c"}
    for k, name in enumerate("abc"):
        known = [r for r in rows if r[k] is not None]
        both = [r for r in known if r[4] is not None]
        o = out[name]
        assert (o.valid_sample_count, o.unique_value_count) == (len(both), len({r[k] for r in known}))
        if name == "c":
            assert o.spearman_to_return_target is None and o.signal_read == "insufficient"
            continue
        assert abs(o.spearman_to_return_target - pearson(average_ranks([r[k] for r in both]), average_ranks([r[4] for r in both]))) < 1e-9
        for c, at in (("return", 5), ("drawdown", 6)):
            mine = [r for r in known if r[at] is not None]
            assert abs(o[f"abs_spearman_to_{c}_label"] - abs(pearson(average_ranks([r[k] for r in mine]), [r[at] for r in mine]))) < 1e-9
        plain = df.withColumnRenamed(name, "v").filter(f"v IS NOT NULL AND {T} IS NOT NULL")
        low, high = plain.agg(F.percentile("v", 0.2), F.percentile("v", 0.8)).first()
        assert abs(o.bottom_quantile_target_mean - plain.filter(F.col("v") <= low).agg(F.avg(T)).first()[0]) < 1e-9
        assert abs(o.top_quantile_target_mean - plain.filter(F.col("v") > high).agg(F.avg(T)).first()[0]) < 1e-9


def test_signal_of_an_empty_panel(spark):
    df, _ = panel(spark)
    assert au.feature_signal(df.limit(0), ["a"]).count() == 0
