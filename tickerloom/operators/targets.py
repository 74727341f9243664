"""Comparison of alternative targets over one tagged prediction table.

Predictions: ``target_id, fold, date, ticker, actual, probability`` and, where
cut by regime, ``regime``.  Every table reads the same predictions, so a target
is fitted once however many tables use it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom import fixed
from tickerloom.functions.buckets import rank_bucket
from tickerloom.operators.metrics import DATE_TIES, segment_metrics
from tickerloom.operators.scorecards import mean_in
from tickerloom.plans.ranking import end_thirds

MIN_SAMPLES = 50


@dataclass(frozen=True)
class Shared:
    """Predictions whose targets have their probability in common: a row for each probability, targets (id -> 0/1 column) side by side."""

    rows: DataFrame
    targets: dict[str, str]


def balance(panel: DataFrame, targets: dict[str, str], h: int = 20) -> DataFrame:
    """Class balance and conditional outcomes per target; targets become rows."""
    excess, drop = f"forward_{h}d_excess_return", f"forward_{h}d_drawdown"
    entries = F.array(*[F.struct(F.lit(t).alias("target_id"), F.col(c).alias("y")) for t, c in targets.items()])
    rows = panel.select(excess, drop, F.inline(entries)).filter("y IS NOT NULL")
    up, down = F.col("y") == 1, F.col("y") == 0
    out = rows.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("y").alias("positive_rate"),
        mean_in(up, excess).alias("mean_forward_excess_return_when_positive"), mean_in(down, excess).alias("mean_forward_excess_return_when_negative"),
        mean_in(up, drop).alias("mean_forward_drawdown_when_positive"), mean_in(down, drop).alias("mean_forward_drawdown_when_negative"),
    )
    p = F.col("positive_rate")
    return out.withColumns(
        {
            "class_balance_status": F.when((p < 0.05) | (p > 0.95), "Unusable").when((p < 0.20) | (p > 0.80), "Skewed").otherwise("Healthy"),
            "too_few_samples": F.col("sample_count") < MIN_SAMPLES,
            "too_rare_positive_class": p < 0.05,
            "too_common_positive_class": p > 0.95,
        }
    )


def _tables(predictions: DataFrame | Shared, by: Sequence[str], scopes: Sequence[Sequence[str]]) -> list[DataFrame]:
    """Metrics and outer thirds for ``by`` and each further scope, from one ordering."""
    if isinstance(predictions, Shared):
        rows, named = predictions.rows, "target_id"
        labels = {t: (F.col(c).isNotNull().cast("int"), F.coalesce(c, F.lit(0.0))) for t, c in predictions.targets.items()}
    else:
        rows, named, labels = predictions.filter(F.col("actual").isNotNull()), None, {"": (F.lit(1), F.col("actual"))}
    by = [b for b in by if b != named]
    return segment_metrics(rows, by, labels, "probability", [[*by, *s] for s in scopes], named, DATE_TIES)


def _spreads(ends: DataFrame, by: Sequence[str], minimum: int = 5) -> DataFrame:
    """Positive rates of the outer thirds from their sizes and positives; NULL below ``minimum`` rows."""
    rate = {x: F.col(f"{x}_total") / F.nullif(F.col(f"{x}_n"), F.lit(0)) for x in ("top", "bottom")}
    enough = (F.col("top_n") >= minimum) & (F.col("bottom_n") >= minimum)
    return ends.select(
        *by, F.col("top_n").alias("top_bucket_count"), F.col("bottom_n").alias("bottom_bucket_count"), F.when(enough, rate["top"]).alias("top_bucket_positive_rate"),
        F.when(enough, rate["bottom"]).alias("bottom_bucket_positive_rate"), F.when(enough, rate["top"] - rate["bottom"]).alias("bucket_spread"),
    )


def _with_spreads(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metric rows with the columns of ``_spreads``; a few rows."""
    ends = _spreads(table, by)
    return table.drop("top_n", "bottom_n", "top_total", "bottom_total").join(ends, list(by), "left")


def bucket_rates(predictions: DataFrame | Shared, by: Sequence[str], minimum: int = 5) -> DataFrame:
    """Positive rate of the top and bottom rank third per group; settled input."""
    by = list(by)
    if isinstance(predictions, Shared):
        return _spreads(_ticker_ends(predictions, by), by, minimum)
    known = predictions.dropna(subset=["actual", "probability"])
    if "ticker" in by:  # at most a row per fold and date
        group = Window.partitionBy(*by)
        place, size = F.row_number().over(group.orderBy("probability", *DATE_TIES)), F.count(F.lit(1)).over(group)
        placed = known.select(*dict.fromkeys([*by, "probability", *DATE_TIES]), "actual").withColumn("_b", rank_bucket(place.cast("long"), size, 3))
        top, bottom = F.col("_b") == 2, F.col("_b") == 0
        ends = placed.groupBy(*by).agg(
            F.count_if(top).alias("top_n"), F.count_if(bottom).alias("bottom_n"),
            F.sum(F.when(top, F.col("actual"))).alias("top_total"), F.sum(F.when(bottom, F.col("actual"))).alias("bottom_total"),
        )
    else:
        ends = end_thirds(known, by, "probability", DATE_TIES, "actual")
    return _spreads(ends, by, minimum)


def _ticker_ends(predictions: Shared, by: Sequence[str]) -> DataFrame:
    """Outer thirds per target and ticker (at most a row per fold and date): the rows are dealt out once for all targets."""
    rest, names = [b for b in by if b != "target_id"], list(predictions.targets)
    group = Window.partitionBy(*rest)
    so_far = group.orderBy("probability", *DATE_TIES).rowsBetween(Window.unboundedPreceding, 0)
    kept = predictions.rows.filter("probability IS NOT NULL").select(
        *dict.fromkeys([*rest, "probability", *DATE_TIES]), *[F.col(c).alias(f"_y{k}") for k, c in enumerate(predictions.targets.values())]
    )
    places = {f"_b{k}": F.when(F.col(f"_y{k}").isNotNull(), rank_bucket(F.count(f"_y{k}").over(so_far), F.count(f"_y{k}").over(group), 3)) for k in range(len(names))}
    sums = []
    for k in range(len(names)):
        for side, b in (("top", 2), ("bottom", 0)):
            there = F.coalesce(F.col(f"_b{k}") == b, F.lit(False))
            sums += [F.count_if(there).alias(f"_{side}_n{k}"), F.sum(F.when(there, F.col(f"_y{k}"))).alias(f"_{side}_total{k}")]
    columns = [f"{side}_{x}" for side in ("top", "bottom") for x in ("n", "total")]
    entries = [F.struct(F.lit(name).alias("target_id"), *(F.col(f"_{c}{k}").alias(c) for c in columns)) for k, name in enumerate(names)]
    return kept.withColumns(places).groupBy(*rest).agg(*sums).select(*rest, F.inline(F.array(*entries)))


def curve_tables(predictions: DataFrame | Shared) -> dict[str, DataFrame]:
    """What ``walk_forward_table`` and ``regime_table`` read of the same predictions, from one ordering."""
    return dict(zip(("all", "fold", "regime"), _tables(predictions, ["target_id"], [[], ["fold"], ["regime"]])))


def walk_forward_table(predictions: DataFrame | Shared, by: Sequence[str] = ("target_id",), tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Metrics, bucket separation and worst fold / ticker per target (and group)."""
    by = list(by)
    found = tables or dict(zip(("all", "fold"), _tables(predictions, by, [[], ["fold"]])))
    base = _with_spreads(found["all"], by).withColumnRenamed("sample_count", "prediction_count")
    folds = found["fold"].groupBy(*by).agg(F.count(F.lit(1)).alias("folds"))
    worst_fold = found["fold"].filter("roc_auc IS NOT NULL").groupBy(*by).agg(F.min(F.struct(F.round("roc_auc", 12).alias("a"), "fold")).alias("_w")).select(
        *by, F.col("_w.fold").alias("worst_fold"), F.col("_w.a").alias("worst_fold_roc_auc")
    )
    per_ticker = bucket_rates(predictions, [*by, "ticker"]).filter("bucket_spread IS NOT NULL")
    worst_ticker = per_ticker.groupBy(*by).agg(F.min(F.struct(F.round("bucket_spread", 12).alias("s"), "ticker")).alias("_w")).select(
        *by, F.col("_w.ticker").alias("worst_ticker"), F.col("_w.s").alias("worst_ticker_bucket_spread")
    )
    out = base.join(folds, by).join(worst_fold, by, "left").join(worst_ticker, by, "left")
    lift = F.col("pr_auc") - F.col("positive_rate")
    no = F.lit(False)
    good = F.coalesce(F.col("roc_auc") >= 0.55, no) | F.coalesce(lift >= 0.05, no) | F.coalesce(F.col("bucket_spread") >= 0.10, no)
    weak = F.coalesce(F.col("roc_auc") < 0.52, F.lit(True)) & F.coalesce(lift < 0.03, F.lit(True)) & F.coalesce(F.col("bucket_spread") < 0.05, F.lit(True))
    return out.withColumn("quality_summary", F.when(good, "Promising").when(weak, "Weak").otherwise("Mixed"))


def fold_calibration(predictions: DataFrame | Shared) -> DataFrame:
    keys = ["target_id", "fold"]
    [table] = _tables(predictions, ["target_id"], [["fold"]])
    return _with_spreads(table, keys).select(
        *keys, "sample_count", F.col("positive_rate").alias("event_rate"), F.col("mean_probability").alias("mean_predicted_probability"), "calibration_gap",
        "top_bucket_count", "bottom_bucket_count",
    )


def regime_table(predictions: DataFrame | Shared, samples: int = 20, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    keys = ["target_id", "regime"]
    out = _with_spreads(tables["regime"] if tables else _tables(predictions, ["target_id"], [["regime"]])[0], keys)
    s = F.col("bucket_spread")
    return out.withColumn(
        "direction",
        F.when((F.col("sample_count") < samples) | s.isNull(), "insufficient").when(s >= 0.05, "positive").when(s <= -0.05, "inverted").otherwise("flat"),
    )


def calibration_grade(gap: Column, brier: Column) -> Column:
    g, b = F.coalesce(F.abs(gap), F.lit(0.0)), F.coalesce(brier, F.lit(0.0))
    return (
        F.when(gap.isNull() & brier.isNull(), "Unavailable").when((g <= 0.05) & (b <= 0.20), "Good").when((g <= 0.10) & (b <= 0.25), "Acceptable").otherwise("Poor")
    )


def separation_grade(spread: Column) -> Column:
    return F.when(spread.isNull(), "Unavailable").when(spread >= 0.05, "Positive").when(spread <= -0.05, "Inverted").otherwise("Weak")


def _group_scores(groups: DataFrame) -> DataFrame:
    """``_s``, the best of three separations (minus infinity if none is known), and its direction ``_d``."""
    score = F.coalesce(F.greatest("bucket_spread", (F.col("roc_auc") - 0.5) * 2, F.col("pr_auc") - F.col("positive_rate")), F.lit(float("-inf")))
    return groups.withColumn("_s", score).withColumn(
        "_d", F.when(F.coalesce("prediction_count", F.lit(0)) <= 0, "insufficient").when(F.col("_s") >= 0.05, "positive").when(F.col("_s") <= -0.05, "inverted").otherwise("flat")
    )


def group_comparison(predictions: DataFrame) -> DataFrame:
    """Metrics per target and feature group; ``predictions`` carries ``target_id`` and ``feature_group``."""
    return walk_forward_table(predictions, ["target_id", "feature_group"])


def group_consistency(groups: DataFrame) -> DataFrame:
    """Best feature group per target and how consistent the groups are."""
    used, pos = F.count_if(F.col("_d") != "insufficient"), F.count_if(F.col("_d") == "positive")
    best = F.struct(F.round("_s", 12), "prediction_count")
    return _group_scores(groups).groupBy("target_id").agg(
        F.max_by("feature_group", best).alias("best_feature_group"),
        F.max_by("roc_auc", best).alias("best_feature_group_auc"),
        F.max("_s").alias("best_feature_group_metric"),
        F.when(used == 0, "Insufficient data").when(pos == used, "Stable across feature groups").when(pos > 0, "Feature-group dependent").otherwise("Weak across feature groups").alias("feature_group_consistency"),
    )


# Feature groups in their order.
GROUP_ORDER = ("technical", "technical_fourier", "technical_wavelet", "all")


def stability(targets: DataFrame, groups: DataFrame, regimes: DataFrame) -> DataFrame:
    """Stability of every target (``target_id``) over feature groups and regimes."""
    place = F.array_position(F.array(*[F.lit(g) for g in GROUP_ORDER]), F.col("feature_group"))
    order = F.struct(F.round("_s", 12), "prediction_count", -F.when(place > 0, place).otherwise(len(GROUP_ORDER) + 1))
    n = {d: F.count_if(F.col("_d") == d) for d in ("positive", "inverted", "flat")}
    used = F.count_if(F.col("_d") != "insufficient")
    consistency = (
        F.when(used == 0, "No usable feature groups").when(n["positive"] == used, "Consistent positive").when((n["positive"] > 0) & (n["inverted"] == 0), "Mostly positive")
        .when(n["positive"] > 0, "Feature-group dependent").when(n["inverted"] > 0, "Inverted or unstable").otherwise("Weak")
    )
    by_group = _group_scores(groups).groupBy("target_id").agg(
        F.max_by("feature_group", order).alias("best_feature_group"), F.max_by(F.coalesce("bucket_spread", "roc_auc"), order).alias("best_feature_group_metric"),
        F.max("_s").alias("_best"), consistency.alias("feature_group_consistency"),
    )
    by_regime = regimes.groupBy("target_id").agg(
        F.count_if(F.col("direction") == "positive").alias("regime_positive_count"), F.count_if(F.col("direction") == "inverted").alias("regime_negative_count"),
        F.min("bucket_spread").alias("worst_regime_bucket_spread"),
    )
    out = targets.select("target_id").distinct().join(by_group, "target_id", "left").join(by_regime, "target_id", "left")
    out = out.withColumns(
        {
            "_best": F.coalesce("_best", F.lit(float("-inf"))),
            "feature_group_consistency": F.coalesce("feature_group_consistency", F.lit("No usable feature groups")),
            "regime_positive_count": F.coalesce("regime_positive_count", F.lit(0)).cast("long"),
            "regime_negative_count": F.coalesce("regime_negative_count", F.lit(0)).cast("long"),
        }
    )
    best, c = F.col("_best"), F.col("feature_group_consistency")
    label = (
        F.when(best == float("-inf"), "Unusable")
        .when((F.col("regime_negative_count") > 0) & (best >= 0.05), "Promising but regime-sensitive")
        .when(c.isin("Feature-group dependent", "Inverted or unstable") & (best >= 0.05), "Feature-group dependent")
        .when((best >= 0.10) & c.isin("Consistent positive", "Mostly positive"), "Strong candidate")
        .when((best >= 0.05) | (F.col("regime_positive_count") > 0), "Promising but regime-sensitive")
        .otherwise("Weak")
    )
    step = F.when(F.col("overall_stability") == "Strong candidate", "Yes").when(F.col("overall_stability").isin("Unusable", "Weak"), "No").otherwise("Review")
    return out.withColumn("overall_stability", label).withColumn("next_step_candidate", step).drop("_best")


# Targets of the arena; the fourth falls back to the fifth name where a table lacks it.
ARENA = ("outperform_20d", "top_tercile_excess_20d", "risk_adjusted_excess_20d", "drawdown_adjusted_opportunity_20d", "pullback_recovery_20d")
ARENA_FALLBACK = ("drawdown_adjusted_opportunity_20d", "tail_adjusted_outperform_20d")


def arena(quality_rows: DataFrame, baseline: str = "outperform_20d") -> DataFrame:
    """Evidence class, decision and rejection reasons of the arena's targets; one row per target comes in."""
    own, other = ARENA_FALLBACK
    there = quality_rows.filter(F.col("target_id") == own).agg((F.count(F.lit(1)) > 0).alias("_own"))
    rows = quality_rows.crossJoin(F.broadcast(there))
    renamed = F.when(~F.col("_own") & (F.col("target_id") == other), own).otherwise(F.col("target_id"))
    rows = rows.withColumn("target_id", renamed).filter(F.col("target_id").isin(*ARENA)).drop("_own")
    columns = ["bucket_spread", "brier_score", "calibration_gap", "regime_inversion_count"]
    base = quality_rows.filter(F.col("target_id") == baseline).agg(*[F.max(c).alias(f"_b_{c}") for c in columns])
    j = rows.crossJoin(F.broadcast(base))
    s, yes = F.col("bucket_spread"), F.lit(True)
    q, b, c = F.col("overall_target_quality"), F.col("bucket_separation_quality"), F.col("calibration_quality")
    g, r = F.col("feature_group_consistency"), F.col("regime_stability")
    sound = (
        F.coalesce(s > 0, F.lit(False)) & F.coalesce(s >= F.col("_b_bucket_spread") - 0.005, yes) & F.coalesce(F.col("brier_score") <= F.col("_b_brier_score") + 0.02, yes)
        & F.coalesce(F.abs("calibration_gap") <= F.abs("_b_calibration_gap") + 0.03, yes)
        & (F.coalesce("regime_inversion_count", F.lit(0)) <= F.coalesce("_b_regime_inversion_count", F.lit(0))) & (g != "Weak across feature groups")
    )
    evidence = (
        F.when((F.coalesce("sample_count", F.lit(0)) < MIN_SAMPLES) | (q == "Unusable") | (F.col("class_balance_status") == "Unusable"), "insufficient")
        .when((q == "Weak") | (b == "Inverted"), "weak")
        .when(F.col("target_id") == baseline, F.when(q == "Mixed", "mixed").otherwise("promising"))
        .when((q == "Promising") & sound & c.isin("Good", "Acceptable") & (r == "Stable across regimes"), "strong")
        .when(sound & (c != "Poor"), "promising").otherwise("mixed")
    )
    e = F.col("evidence_classification")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("class_balance_status").isin("Skewed", "Unusable"), F.concat(F.lit("class balance is "), F.lower("class_balance_status"))),
            F.when(c == "Poor", "calibration is poor"), F.when(b.isin("Weak", "Inverted"), F.concat(F.lit("bucket separation is "), F.lower(b))),
            F.when(r == "Inverted in some regimes", "some regimes are inverted").when(r == "Regime-sensitive", "evidence is regime-sensitive"),
            F.when(g == "Weak across feature groups", "feature-group stability is weak"),
        )
    )
    reason = F.when(e.isin("strong", "promising"), "").when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("evidence is not clearly better than the current production target")
    decision = F.when(F.col("target_id") == baseline, "current_baseline").when(e == "strong", "best_candidate").when(e == "promising", "future_research_candidate").otherwise("reject_for_now")
    out = j.withColumn("evidence_classification", evidence).withColumns(
        {
            "rejection_reason": reason, "arena_decision": decision,
            "future_production_experiment": e.isin("strong", "promising") & (F.col("target_id") != baseline),
        }
    )
    return out.drop(*[f"_b_{x}" for x in columns])


def quality(balance_rows: DataFrame, walk_rows: DataFrame, regime_rows: DataFrame, group_rows: DataFrame | None = None, baseline: str = "outperform_20d") -> DataFrame:
    """Grades, production status against the baseline target, and rank."""
    used, bad, good = F.count_if(F.col("direction") != "insufficient"), F.count_if(F.col("direction") == "inverted"), F.count_if(F.col("direction") == "positive")
    regimes = regime_rows.groupBy("target_id").agg(
        F.when(used == 0, "Insufficient data").when(bad > 0, "Inverted in some regimes").when(good == used, "Stable across regimes").otherwise("Regime-sensitive").alias("regime_stability"),
        bad.alias("regime_inversion_count"), F.min("bucket_spread").alias("worst_regime_bucket_spread"),
    )
    keep = ["target_id", "folds", "prediction_count", "roc_auc", "pr_auc", "brier_score", "calibration_gap", "bucket_spread", "worst_fold", "worst_fold_roc_auc", "worst_ticker", "worst_ticker_bucket_spread"]
    out = balance_rows.select("target_id", "sample_count", "positive_rate", "class_balance_status").join(walk_rows.select(*keep), "target_id", "full_outer").join(regimes, "target_id", "full_outer")
    if group_rows is not None:
        out = out.join(group_consistency(group_rows), "target_id", "full_outer")
    else:
        out = out.withColumn("feature_group_consistency", F.lit("Insufficient data"))
    out = out.withColumns(
        {
            "regime_stability": F.coalesce("regime_stability", F.lit("Insufficient data")),
            "regime_inversion_count": F.coalesce("regime_inversion_count", F.lit(0)),
            "feature_group_consistency": F.coalesce("feature_group_consistency", F.lit("Insufficient data")),
            "calibration_quality": calibration_grade(F.col("calibration_gap"), F.col("brier_score")),
            "bucket_separation_quality": separation_grade(F.col("bucket_spread")),
        }
    )
    rate, no = F.col("positive_rate"), F.lit(False)
    b, c, g, r = F.col("bucket_separation_quality"), F.col("calibration_quality"), F.col("feature_group_consistency"), F.col("regime_stability")
    overall = (
        F.when((F.col("sample_count") < MIN_SAMPLES) | (F.col("class_balance_status") == "Unusable") | F.coalesce((rate < 0.05) | (rate > 0.95), no), "Unusable")
        .when((b == "Inverted") | F.coalesce(F.col("roc_auc") < 0.50, no) | (F.col("regime_inversion_count") > 1), "Weak")
        .when(
            (F.col("class_balance_status") == "Healthy") & (b == "Positive") & c.isin("Good", "Acceptable") & (g != "Weak across feature groups")
            & r.isin("Stable across regimes", "Insufficient data"), "Promising",
        )
        .when((c == "Poor") | r.isin("Regime-sensitive", "Inverted in some regimes"), "Mixed")
        .when(g == "Weak across feature groups", "Weak")
        .otherwise("Mixed")
    )
    out = out.withColumn("overall_target_quality", overall)
    base = out.filter(F.col("target_id") == baseline).agg(
        F.max("overall_target_quality").alias("_bq"), F.max("bucket_spread").alias("_bs"), F.max("roc_auc").alias("_ba")
    )
    q = F.col("overall_target_quality")
    beats = (
        F.col("_bq").isNull() | F.col("_bq").isin("Weak", "Unusable")
        | F.coalesce(F.col("bucket_spread").isNotNull() & (F.col("_bs").isNull() | (F.col("bucket_spread") >= F.col("_bs") + 0.03)), no)
        | F.coalesce(F.col("roc_auc").isNotNull() & (F.col("_ba").isNull() | (F.col("roc_auc") >= F.col("_ba") + 0.02)), no)
    )
    is_base = F.col("target_id") == baseline
    status = (
        F.when(is_base, F.when(q == "Unusable", "Insufficient evidence").otherwise("Keep baseline"))
        .when(q == "Unusable", "Reject for now")
        .when((F.col("class_balance_status") == "Skewed") & (b == "Positive"), "Special setup only")
        .when((q == "Promising") & beats, F.when((r == "Inverted in some regimes") | (g == "Weak across feature groups"), "Research-only candidate").otherwise("Candidate for production trial"))
        .when(q == "Weak", "Reject for now")
        .otherwise("Research-only candidate")
    )
    out = out.crossJoin(F.broadcast(base)).withColumn("production_candidate_status", status).drop("_bq", "_bs", "_ba")
    def points(table: dict[str, float], c: str) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(c)], F.lit(0.0))

    metric = F.coalesce("bucket_spread", F.lit(0.0)) + F.coalesce(F.col("roc_auc") - 0.5, F.lit(0.0))
    evidence = points(fixed.CALIBRATION_POINTS, "calibration_quality") + points(fixed.STABILITY_POINTS, "regime_stability") + points(fixed.GROUP_POINTS, "feature_group_consistency")
    keys = [points(fixed.QUALITY_POINTS, "overall_target_quality"), points(fixed.STATUS_POINTS, "production_candidate_status"), F.round(metric, 9), evidence, F.col("target_id")]
    return out.withColumn("candidate_rank", F.row_number().over(Window.orderBy(*[k.desc() for k in keys])))  # one row per target


def stop_rule(quality_rows: DataFrame, baseline: str = "outperform_20d") -> DataFrame:
    """Differences to the baseline target, pass / fail with its diagnosis, likely cause and decision.

    An unknown spread fails; any other unknown value passes its own test.
    """
    columns = ["roc_auc", "pr_auc", "brier_score", "bucket_spread", "calibration_gap", "regime_inversion_count", "folds"]
    base = quality_rows.filter(F.col("target_id") == baseline).select(*[F.col(c).alias(f"_b_{c}") for c in columns])
    j = quality_rows.crossJoin(F.broadcast(base))
    gap = F.abs("calibration_gap") - F.abs("_b_calibration_gap")
    s, quality_name = F.col("bucket_spread"), F.col("overall_target_quality")
    no_spread = s.isNull() | (s <= 0)
    reasons = F.array_compact(
        F.array(
            F.when(no_spread, "bucket spread is unavailable or non-positive").when(s < F.col("_b_bucket_spread") - 0.005, "bucket spread is worse than baseline tolerance"),
            F.when(F.col("brier_score") > F.col("_b_brier_score") + 0.02, "Brier score is worse than baseline tolerance"),
            F.when(gap > 0.03, "calibration gap is worse than baseline tolerance"),
            F.when(F.col("regime_inversion_count") > F.col("_b_regime_inversion_count"), "regime inversion count is worse than baseline"),
            F.when(F.col("feature_group_consistency") == "Weak across feature groups", "feature-group stability is weak"),
            F.when(quality_name.isin("Weak", "Unusable"), F.concat(F.lit("overall target quality is "), F.lower(quality_name))),
        )
    )
    is_base, rate = F.col("target_id") == baseline, F.col("positive_rate")
    failed = F.size("_reasons") > 0
    thin = F.col("target_id").contains("60d") | F.coalesce(F.col("folds") < F.col("_b_folds"), F.lit(False))
    causes = F.array_compact(
        F.array(
            F.when(thin, "horizon mismatch / thin folds"),
            F.when(F.col("class_balance_status").isin("Skewed", "Unusable") | (rate < 0.20) | (rate > 0.80), "target design / class imbalance"),
            F.when(gap > 0.03, "target noise / calibration"),
            F.when((F.col("regime_inversion_count") > 0) & (F.col("worst_regime_bucket_spread") < 0), "regime inversion"),
            F.when(F.exists("_reasons", lambda x: x.contains("bucket spread")), "weak feature separation"),
        )
    )
    missing = F.lit(False)
    for c in ("roc_auc", "bucket_spread", "folds", "prediction_count"):
        missing = missing | F.col(c).isNull()
    decision = (
        F.when(is_base, "Continue").when(missing, "Needs more data").when(~failed, "Continue").when(F.col("class_balance_status") == "Unusable", "Kill")
        .when(F.col("target_id") == "pullback_recovery_20d", "Hold as audit-only").when(thin, "Needs more data").when(F.col("roc_auc") - F.col("_b_roc_auc") < -0.05, "Kill").otherwise("Pivot")
    )
    cause = (
        F.when(is_base, "current baseline").when(missing, "missing evidence fields").when(F.size("_causes") > 0, F.array_join("_causes", "; "))
        .when(failed, "mixed validation evidence").otherwise("evidence clears stop rule")
    )
    diagnosis = (
        F.when(is_base, "Current production target baseline for comparison.").when(failed, F.array_join("_reasons", "; "))
        .otherwise("Candidate clears the research stop rule versus the current baseline.")
    )
    deltas = {f"{c}_delta": F.col(c) - F.col(f"_b_{c}") for c in columns if c not in ("calibration_gap", "folds")} | {"absolute_calibration_gap_delta": gap}
    out = j.withColumns(deltas).withColumn("_reasons", reasons).withColumn("_causes", causes)
    out = out.withColumns(
        {
            "stop_rule_result": F.when(is_base, "baseline").when(failed, "fail").otherwise("pass"),
            "stop_rule_diagnosis": diagnosis,
            "likely_failure_cause": cause,
            "recommended_decision": decision,
        }
    )
    return out.drop("_reasons", "_causes", *[f"_b_{c}" for c in columns])


def class_counts(rows: DataFrame) -> DataFrame:
    """area, c, n: how often each known classification occurs in ``rows`` of (area, classification)."""
    return rows.filter("classification IS NOT NULL").groupBy("area", F.lower("classification").alias("c")).agg(F.count(F.lit(1)).alias("n"))


def evidence_rollup(rows: DataFrame, areas: Sequence[str]) -> DataFrame:
    """Worst classification per area, its strength and readiness, and the overall row.

    ``rows`` is ``(area, classification)``; an area without rows is unavailable.
    The first label of the fixed priority list that an area has stands for it; with
    none of them, its most frequent one (of equally frequent ones the first by name).
    """
    return evidence_of(class_counts(rows), areas)


def evidence_of(parts: DataFrame, areas: Sequence[str]) -> DataFrame:
    """``evidence_rollup`` of ``class_counts``, which may come in several rows of a class."""
    spark = parts.sparkSession
    counts = parts.groupBy("area", "c").agg(F.sum("n").alias("n"))
    place = F.array_position(F.array(*[F.lit(p) for p in fixed.EVIDENCE_PRIORITY]), F.col("c"))
    order = F.struct(F.when(place > 0, place).otherwise(len(fixed.EVIDENCE_PRIORITY) + 1), F.when(place > 0, 0).otherwise(-F.col("n")), "c")
    worst = counts.groupBy("area").agg(F.min_by("c", order).alias("latest_classification"))
    named = spark.createDataFrame([(a,) for a in areas], "area string")
    out = named.join(worst, "area", "left").withColumn("latest_classification", F.coalesce("latest_classification", F.lit("unavailable")))
    strength = F.lit(None).cast("string")
    for name, labels in fixed.EVIDENCE_STRENGTH.items():
        strength = F.when(F.col("latest_classification").isin(*labels), name).otherwise(strength)
    out = out.withColumn("evidence_strength", F.coalesce(strength, F.lit("watch")))
    s = F.col("evidence_strength")
    out = out.withColumn("production_readiness", F.when(s == "useful", "research_only").when(s == "unavailable", "unavailable").otherwise("not_ready"))
    overall = spark.createDataFrame([("Overall production readiness", "not_ready", "blocking", "not_ready")], out.schema)
    return out.unionByName(overall)
