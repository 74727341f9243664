"""Allocation, buckets, shapes and other decision rules at their edges."""

from pyspark.sql import functions as F

from tickerloom import fixed
from tickerloom.functions.buckets import rank_bucket, score_band, shape
from tickerloom.operators import allocation as al
from tickerloom.operators import audits as au
from tickerloom.operators import crowding as cr
from tickerloom.operators import decision as dc
from tickerloom.operators import models as md


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_score_bands_are_right_closed(spark):
    assert [one(spark, score_band(F.lit(float(x)))) for x in (40, 40.1, 70, 70.1)] == ["Low", "Medium", "Medium", "High"]


def test_rank_buckets_match_equal_count_cuts(spark):
    import pandas as pd

    for n in (3, 6, 20, 60):  # no rank sits exactly on an edge
        want = pd.qcut(pd.Series(range(1, n + 1)), q=3, labels=False).tolist()
        got = [r.b for r in spark.range(1, n + 1).select(rank_bucket(F.col("id"), F.lit(n), 3).alias("b")).collect()]
        assert got == want


def test_shapes(spark):
    def read(*xs):
        return one(spark, shape([F.lit(x).cast("double") for x in xs]))

    assert [read(0, 1, 2), read(2, 1, 0), read(0, 0.001, 0.002), read(0, 1, 0.5), read(None, 1, None)] == ["aligned", "inverted", "flat", "mixed", "insufficient"]


def test_zero_drawdown_probability_counts_as_certain(spark):
    w = lambda risk: one(spark, al.raw_weight(F.lit(80.0), F.lit(risk).cast("double"), F.lit(fixed.UP_CALM), al.Limits()))
    assert w(0.0) == 0.0 and w(0.1) == 0.12 and w(0.45) == 0.06 and w(None) == 0.0


def test_allocation_scales_to_the_cap(spark):
    df = spark.createDataFrame([(f"T{i}", 95.0, 0.1, fixed.UP_CALM) for i in range(10)], "ticker string, ml_score double, probability_risk double, regime string")
    out = al.allocate(df).collect()
    assert round(sum(r.target_weight for r in out), 9) == 0.9
    assert {r.suggested_action for r in out} == {"Add"}


def test_targets_at_the_cap_are_no_excess(spark):
    parts = [(day, 0.9 / day) for day in range(1, 200) for _ in range(day)]
    over = [(1000, 0.1)] * 10
    df = spark.createDataFrame(parts + over, "rebalance_date long, target_weight double")
    out = al.guardrails(df, F.lit(False), F.lit(0.0))
    flagged = [r.rebalance_date for r in out.filter("risk_control_flags <> ''").select("rebalance_date").distinct().collect()]
    assert flagged == [1000]
    assert all(abs(r.w - 0.9) < 1e-12 for r in out.groupBy("rebalance_date").agg(F.sum("adjusted_weight").alias("w")).collect())


def test_actions(spark):
    got = [one(spark, al.action(F.lit(a), F.lit(b))) for a, b in ((0.1, 0.0), (0.0, 0.0), (0.0, 0.05), (0.05, 0.1), (0.1, 0.05), (0.1, 0.105))]
    assert got == ["Exit", "Watch", "Add", "Add", "Trim", "Hold"]


def test_shortlist_reads_percent_strings(spark):
    df = spark.createDataFrame([("A", 80.0, "65%", "Add", 1.0), ("B", 80.0, "0.2", "Add", 9.0), ("C", 30.0, None, "Hold", None)], "ticker string, ml_score double, drawdown_risk_probability string, suggested_action string, relative_strength_rank double")
    names = lambda v: sorted(r.ticker for r in dc.shortlist(df, v).collect())
    assert names("Strong setups") == ["B"] and names("High pullback risk") == ["A"] and names("Weak or avoid") == ["C"]
    assert names("Watchlist / wait for pullback") == ["A"]


def test_components_of_a_long_chain(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(9)] + [("x", "y")]
    got = cr.components(spark.createDataFrame(edges, "ticker_a string, ticker_b string")).collect()
    assert {r.cluster for r in got if r.ticker.startswith("n")} == {"n00"}
    assert {r.cluster for r in got if r.ticker in "xy"} == {"x"}


def test_pruning_prefers_derived_features_and_follows_replacements(spark):
    import math

    rows = [(math.sin(i), math.sin(i) + 0.02 * math.cos(7 * i), math.sin(i) + 0.002 * math.cos(5 * i), math.cos(3 * i)) for i in range(300)]
    panel = spark.createDataFrame(rows, "fourier_amp_1 double, fourier_cycle_strength double, fourier_freq_2 double, fourier_other double")
    got = {d: k for d, k, _ in au.redundant(panel, panel.columns)}
    assert got == {"fourier_amp_1": "fourier_cycle_strength", "fourier_freq_2": "fourier_cycle_strength"}
    assert au.redundant(panel, ["fourier_other", "fourier_amp_1"]) == [] == au.redundant(panel, ["fourier_other"])


def test_label_columns_cannot_be_features():
    import pytest

    with pytest.raises(ValueError):
        au.require_no_leak(["return_20d", "forward_20d_return"])


def test_single_class_gives_a_constant(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "f double, y double")
    assert [r.probability for r in md.fit(df, ["f"], "y", "logistic_regression").score(df).collect()] == [1.0, 1.0]


def test_all_null_feature_is_kept(spark):
    df = spark.createDataFrame([(float(i), None, float(i > 20)) for i in range(40)], "f double, g double, y double")
    out = md.fit(df, ["f", "g"], "y", "logistic_regression").score(df).collect()
    assert out[0].probability < 0.2 < 0.8 < out[-1].probability


def test_overlapping_folds_stay_one_row(spark):
    a = spark.createDataFrame([(1, "2024-01-01", "A", 1.0, 0.4), (2, "2024-01-01", "A", 1.0, 0.6)], "fold int, date string, ticker string, actual double, probability double")
    assert md.merge_predictions(a, a).count() == 2
    assert md.merge_predictions(a.drop("fold"), a).count() == 1


def test_targets_keep_only_what_is_named(spark, sf):
    from tickerloom.operators import labels as lb
    from workload import fixtures as fx

    light = fx.light(spark, sf)
    names = ["return_20d", "label_top_tercile_excess_20d", "label_outperform_60d"]
    narrow = lb.target_candidates(light, "SPY", keep=names)
    assert narrow.columns == ["ticker", "date", *names]
    whole = lb.target_candidates(light, "SPY").select(narrow.columns)
    assert narrow.exceptAll(whole).isEmpty() and whole.exceptAll(narrow).isEmpty()
