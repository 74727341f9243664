"""Diagnostic tables over a score panel.

Input columns: fold, date, ticker, ml_score, probability_out, actual_out,
probability_risk, actual_risk, forward_return, forward_excess_return,
forward_drawdown and, where a table is cut by regime, ``regime``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.buckets import TOLERANCE, rank_bucket, score_band, shape, spread_direction, third
from tickerloom.functions.stats import correlation
from tickerloom.operators.metrics import DATE_TIES, binary_metrics, quantile_bucketed, worst_group
from tickerloom.plans.ranking import with_positions

SAMPLES, BUCKET, CLASS = 20, 5, 5
BANDS = ("Low", "Medium", "High")


def mean_in(condition: Column, value: str) -> Column:
    return F.avg(F.when(condition, F.col(value)))


def band_aggregates(score: Column, value: str, minimum: int, prefix: str) -> list[Column]:
    """Mean of ``value`` per band where at least ``minimum`` known rows exist."""
    band = score_band(score)
    out = []
    for b in BANDS:
        inside = (band == b) & F.col(value).isNotNull()
        out.append(F.when(F.count_if(inside) >= minimum, mean_in(inside, value)).alias(f"{prefix}_{b.lower()}"))
    return out


def spread(prefix: str) -> Column:
    return F.col(f"{prefix}_high") - F.col(f"{prefix}_low")


def score_buckets(scores: DataFrame) -> DataFrame:
    known = scores.dropna(subset=["ml_score", "actual_out"])
    return known.groupBy(score_band(F.col("ml_score")).alias("score_bucket")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("ml_score").alias("average_ml_score"),
        F.avg("actual_out").alias("outperformance_hit_rate"),
        F.avg("probability_out").alias("average_outperformance_probability"),
        F.avg("probability_risk").alias("average_drawdown_risk_probability"),
        F.avg("actual_risk").alias("drawdown_risk_rate"),
        F.avg("forward_return").alias("average_forward_return"),
        F.avg("forward_excess_return").alias("average_forward_excess_return"),
        F.avg("forward_drawdown").alias("average_forward_drawdown"),
    )


def baseline_comparison(scores: DataFrame, baseline: str, signal: str, minimum: int = 5) -> DataFrame:
    """ML score, no-skill and one simple baseline; ``scores`` must be settled."""
    target = "forward_excess_return"

    def row(frame: DataFrame, name: str, top: Column, bottom: Column, n: Column, enough: Column) -> DataFrame:
        return frame.agg(n.alias("sample_size"), F.when(enough, top).alias("top"), F.when(enough, bottom).alias("bottom")).select(
            F.lit(name).alias("signal"), "sample_size", F.col("top").alias("top_bucket_forward_return"), F.col("bottom").alias("bottom_bucket_forward_return")
        )

    n = F.count(F.lit(1))
    ml = scores.dropna(subset=["ml_score", target]).withColumn("_b", score_band(F.col("ml_score")))
    hi, lo = F.col("_b") == "High", F.col("_b") == "Low"
    rows = row(ml, "ML score", mean_in(hi, target), mean_in(lo, target), n,
               (n >= 2 * minimum) & (F.count_if(hi) >= minimum) & (F.count_if(lo) >= minimum))
    flat = scores.dropna(subset=[target])
    rows = rows.unionByName(row(flat, "No-skill / universe average", F.avg(target), F.avg(target), n, n >= 2 * minimum))
    cut = quantile_bucketed(scores.dropna(subset=[baseline, target]), [], baseline, 3, "_b")
    ends = cut.crossJoin(F.broadcast(cut.agg(F.max("_b").alias("_top"), F.min("_b").alias("_bottom"))))
    hi, lo = F.col("_b") == F.col("_top"), F.col("_b") == F.col("_bottom")
    rows = rows.unionByName(
        row(ends, signal, mean_in(hi, target), mean_in(lo, target), n,
            (n >= 2 * minimum) & (F.max("_top") > F.max("_bottom")) & (F.count_if(hi) >= minimum) & (F.count_if(lo) >= minimum))
    )
    out = rows.withColumn("spread", F.col("top_bucket_forward_return") - F.col("bottom_bucket_forward_return"))
    refs = out.agg(
        F.max(F.when(F.col("signal") == "ML score", F.col("spread"))).alias("_ml"),
        F.coalesce(F.max(F.when(F.col("signal") != "ML score", F.col("spread"))), F.lit(0.0)).alias("_best"),
    )
    is_ml = F.col("signal") == "ML score"
    other = F.when(is_ml, F.col("_best")).otherwise(F.col("_ml"))
    return out.crossJoin(F.broadcast(refs)).select(
        "signal", "sample_size", "top_bucket_forward_return", "bottom_bucket_forward_return", "spread",
        F.when(F.col("spread").isNull(), "insufficient").when(F.col("spread") > 0, "top bucket higher")
        .when(F.col("spread") < 0, "bottom bucket higher").otherwise("flat").alias("direction"),
        F.when(F.col("spread").isNull() | F.col("_ml").isNull(), "insufficient")
        .when(F.col("signal").startswith("No-skill"), "reference")
        .when(F.col("spread") > other + TOLERANCE, "better")
        .when(F.col("spread") + TOLERANCE < other, "worse")
        .otherwise("similar").alias("relative_read"),
    )


def regime_segments(scores: DataFrame, dimensions: Sequence[str], minimum: int = BUCKET, samples: int = SAMPLES) -> DataFrame:
    """Score spread per regime dimension and value; dimensions become rows, not passes."""
    known = scores.dropna(subset=["ml_score", "forward_excess_return"])
    pairs = F.array(*[F.struct(F.lit(d).alias("regime_dimension"), F.col(d).cast("string").alias("regime")) for d in dimensions])
    rows = known.select("ml_score", "forward_excess_return", F.inline(pairs)).filter(F.trim("regime") != "")
    band = score_band(F.col("ml_score"))
    out = rows.groupBy("regime_dimension", "regime").agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.count_if(band == "High").alias("top_bucket_sample_size"),
        F.count_if(band == "Low").alias("bottom_bucket_sample_size"),
        *band_aggregates(F.col("ml_score"), "forward_excess_return", minimum, "m"),
    )
    s = F.when(F.col("sample_size") >= samples, spread("m"))
    return out.select(
        "regime_dimension", "regime", "sample_size", "top_bucket_sample_size", "bottom_bucket_sample_size",
        F.col("m_medium").alias("middle_bucket_forward_return"), F.col("m_high").alias("top_bucket_forward_return"),
        F.col("m_low").alias("bottom_bucket_forward_return"), spread("m").alias("spread"),
        spread_direction(spread("m"), F.col("sample_size"), samples).alias("direction"),
        F.when(s.isNull(), "insufficient").when(s > TOLERANCE, "usable").when(s < -TOLERANCE, "inverted").otherwise("mixed").alias("evidence_quality"),
    )


def reliability_by_regime(scores: DataFrame, by: str = "regime", samples: int = SAMPLES, classes: int = CLASS, minimum: int = BUCKET) -> DataFrame:
    """Discrimination, calibration and bucket evidence per regime; settled input."""
    base = binary_metrics(scores, [by], "actual_out", "probability_out")
    risk = F.col("probability_risk") - F.col("actual_risk")
    other = scores.groupBy(by).agg(
        *band_aggregates(F.col("ml_score"), "forward_excess_return", minimum, "r"),
        *band_aggregates(F.col("ml_score"), "actual_risk", minimum, "d"),
        F.avg(risk * risk).alias("drawdown_brier"),
        (-F.avg(risk)).alias("drawdown_calibration_gap"),
    )
    known = F.col("r_low").isNotNull() & F.col("r_medium").isNotNull() & F.col("r_high").isNotNull()
    known_d = F.col("d_low").isNotNull() & F.col("d_medium").isNotNull() & F.col("d_high").isNotNull()
    out = base.join(other, by).withColumns(
        {
            "bucket_spread": F.when(known, spread("r")),
            "score_bucket_monotonicity": F.when(known, shape([F.col("r_low"), F.col("r_medium"), F.col("r_high")])).otherwise("insufficient"),
            "drawdown_bucket_spread": F.when(known_d, spread("d")),
        }
    )
    s, mono = F.col("bucket_spread"), F.col("score_bucket_monotonicity")
    negatives = F.col("sample_count") - F.col("positive_count")
    thin = (F.col("sample_count") < samples) | (F.col("positive_count") < classes) | (negatives < classes) | s.isNull()
    inverted = ~thin & ((s < -TOLERANCE) | (mono == "inverted"))
    weak_return = (
        F.col("roc_auc").isNull() | F.col("pr_auc").isNull() | (F.col("roc_auc") < 0.52)
        | (F.col("pr_auc") < F.col("positive_rate") + 0.02) | ~mono.isin("aligned", "flat") | (s <= TOLERANCE)
    )
    weak_risk = F.col("drawdown_brier").isNull() | (F.col("drawdown_brier") > 0.25) | F.coalesce(F.abs("drawdown_calibration_gap") > 0.15, F.lit(False))
    conflict = F.coalesce(F.col("drawdown_bucket_spread") > TOLERANCE, F.lit(False)) & (s <= TOLERANCE)
    return out.select(
        by, "sample_count", "positive_rate", "roc_auc", "pr_auc", F.col("brier_score").alias("brier"), "bucket_spread",
        "score_bucket_monotonicity", "drawdown_brier", "drawdown_calibration_gap", "drawdown_bucket_spread",
        inverted.alias("inversion_flag"), thin.alias("insufficient_sample_flag"),
        F.when(thin, "insufficient_sample").when(inverted, "inverted").when(weak_return & conflict, "unstable")
        .when(~weak_return & ~weak_risk, "reliable").otherwise("mixed").alias("classification"),
    )


def bucket_audit(scores: DataFrame, by: str = "regime", samples: int = SAMPLES, minimum: int = BUCKET) -> DataFrame:
    """Does a high score mean opportunity or overextension in each regime?"""
    known = scores.dropna(subset=[by, "ml_score", "forward_excess_return", "actual_out"]).withColumn("_b", score_band(F.col("ml_score")))
    hi, lo = F.col("_b") == "High", F.col("_b") == "Low"
    main = known.groupBy(by).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_distinct("ticker").alias("ticker_count"),
        F.count_distinct("fold").alias("fold_count"),
        F.count_if(hi).alias("high_score_sample_count"),
        F.count_if(lo).alias("low_score_sample_count"),
        mean_in(hi, "actual_out").alias("high_score_bucket_outcome_rate"),
        mean_in(lo, "actual_out").alias("low_score_bucket_outcome_rate"),
        mean_in(hi, "forward_excess_return").alias("high_score_avg_forward_excess_return"),
        mean_in(lo, "forward_excess_return").alias("low_score_avg_forward_excess_return"),
        mean_in(hi, "actual_risk").alias("high_score_drawdown_rate"),
        mean_in(lo, "actual_risk").alias("low_score_drawdown_rate"),
    )
    means = known.filter(hi).groupBy(by, "ticker").agg(F.round(F.avg("forward_excess_return"), 12).alias("m"))
    worst = means.groupBy(by).agg(F.min(F.struct("m", "ticker"))["ticker"].alias("worst_ticker"))
    no = F.lit(False)
    out = main.join(worst, by, "left").withColumns(
        {
            "opportunity_bucket_spread": F.col("high_score_bucket_outcome_rate") - F.col("low_score_bucket_outcome_rate"),
            "drawdown_reversal_bucket_spread": F.col("high_score_drawdown_rate") - F.col("low_score_drawdown_rate"),
        }
    )
    o, d = F.col("opportunity_bucket_spread"), F.col("drawdown_reversal_bucket_spread")
    inverted = F.coalesce(o < -TOLERANCE, no) | F.coalesce(
        F.col("high_score_avg_forward_excess_return") < F.col("low_score_avg_forward_excess_return") - TOLERANCE, no
    )
    riskier = F.coalesce(d > TOLERANCE, no)
    thin = (F.col("sample_count") < samples) | (F.col("high_score_sample_count") < minimum) | (F.col("low_score_sample_count") < minimum)
    cases = [
        (thin, "insufficient_evidence", "Needs more data"),
        (inverted & riskier, "overextension_risk", "Pivot"),
        (inverted, "worse_opportunity_outcome", "Pivot"),
        (F.coalesce(o > TOLERANCE, no) & ~riskier, "better_opportunity_outcome", "Continue"),
        (riskier, "higher_drawdown_reversal_risk", "Pivot"),
        (F.lit(True), "mixed", "Hold as audit-only"),
    ]

    def pick(i: int) -> Column:
        column = F.when(cases[0][0], cases[0][i])
        for c in cases[1:]:
            column = column.when(c[0], c[i])
        return column

    return out.withColumns(
        {"inversion_flag": inverted, "overextension_risk_flag": inverted & riskier, "classification": pick(1), "recommended_decision": pick(2)}
    )


def direction_summary(scores: DataFrame, minimum: int = BUCKET, samples: int = SAMPLES) -> DataFrame:
    """Rank correlation of the score with return and labels, and its spread; settled input.

    A binary label is an affine image of its own average rank, so only the score
    and the return need ranking.
    """
    known = scores.dropna(subset=["ml_score", "forward_excess_return"])
    first = with_positions(known, [], "ml_score", DATE_TIES, ranks=True).withColumnRenamed("avg_rank", "_rs").drop("pos", "min_rank", "group_size")
    both = with_positions(first, [], "forward_excess_return", DATE_TIES, ranks=True)
    out = both.agg(
        F.count(F.lit(1)).alias("sample_size"),
        correlation(F.col("_rs"), F.col("avg_rank")).alias("score_to_forward_return_spearman"),
        correlation(F.col("_rs"), F.col("actual_out")).alias("score_to_return_label_spearman"),
        correlation(F.col("_rs"), F.col("actual_risk")).alias("score_to_drawdown_label_spearman"),
        *band_aggregates(F.col("ml_score"), "forward_excess_return", minimum, "m"),
    )
    return out.select(
        "sample_size", "score_to_forward_return_spearman", "score_to_return_label_spearman", "score_to_drawdown_label_spearman",
        F.col("m_high").alias("top_bucket_forward_return"), F.col("m_low").alias("bottom_bucket_forward_return"),
        spread("m").alias("top_minus_bottom_spread"), spread_direction(spread("m"), F.col("sample_size"), samples).alias("direction"),
    )


def regime_direction(scores: DataFrame, dimensions: Sequence[str] = ("regime",), minimum: int = BUCKET, samples: int = SAMPLES) -> DataFrame:
    """Score direction per value of every regime column; the columns become rows of one grouped pass."""
    known = scores.dropna(subset=["ml_score", "forward_excess_return"])
    entries = F.array(*[F.struct(F.lit(d).alias("regime_dimension"), F.trim(F.col(d).cast("string")).alias("_v")) for d in dimensions])
    rows = known.select("ml_score", "forward_excess_return", F.inline(entries)).filter("_v IS NOT NULL AND _v <> ''").withColumnRenamed("_v", "regime")
    out = rows.groupBy("regime_dimension", "regime").agg(F.count(F.lit(1)).alias("sample_size"), *band_aggregates(F.col("ml_score"), "forward_excess_return", minimum, "m"))
    return out.select(
        "regime_dimension", "regime", "sample_size", F.col("m_high").alias("top_bucket_forward_return"), F.col("m_low").alias("bottom_bucket_forward_return"),
        spread("m").alias("top_minus_bottom_spread"), spread_direction(spread("m"), F.col("sample_size"), samples).alias("direction"),
    )


# Alignment diagnostics, column and the two readings.
ALIGNMENTS = (
    ("outperformance probability", "probability_out", "higher outperformance probability", "lower outperformance probability"),
    ("realised forward excess return", "forward_excess_return", "higher realised forward excess return", "lower realised forward excess return"),
    ("outperformance label rate", "actual_out", "higher outperformance label rate", "lower outperformance label rate"),
    ("drawdown-risk label rate", "actual_risk", "higher drawdown-risk label rate", "lower drawdown-risk label rate"),
    ("realised drawdown event rate", "drawdown_event", "higher realised drawdown event rate", "lower realised drawdown event rate"),
    ("realised forward drawdown", "forward_drawdown", "less severe realised drawdowns", "more severe realised drawdowns"),
)


def alignment(scores: DataFrame, minimum: int = BUCKET) -> DataFrame:
    """Top-minus-bottom band mean of six value columns in one grouped pass."""
    entries = F.array(
        *[
            F.struct(F.lit(d).alias("diagnostic"), F.col(c).cast("double").alias("v"), F.lit(up).alias("up"), F.lit(down).alias("down"))
            for d, c, up, down in ALIGNMENTS
        ]
    )
    event = (F.col("forward_drawdown") <= -0.10).cast("double")
    rows = scores.filter("ml_score IS NOT NULL").withColumn("drawdown_event", event).select("ml_score", F.inline(entries)).filter("v IS NOT NULL")
    out = rows.groupBy("diagnostic", "up", "down").agg(F.count(F.lit(1)).alias("sample_size"), *band_aggregates(F.col("ml_score"), "v", minimum, "m"))
    s = spread("m")
    both = s.isNotNull()
    return out.select(
        "diagnostic", "sample_size", F.when(both, F.col("m_low")).alias("bottom_score_bucket_mean"), F.when(both, F.col("m_high")).alias("top_score_bucket_mean"),
        s.alias("top_minus_bottom_spread"),
        F.when(s.isNull(), "insufficient").when(s > TOLERANCE, F.col("up")).when(s < -TOLERANCE, F.col("down")).otherwise("similar values").alias("higher_score_corresponds_to"),
    )


def bucket_monotonicity(scores: DataFrame) -> DataFrame:
    """Per-band means and the overall shape of mean returns."""
    known = scores.dropna(subset=["ml_score", "forward_excess_return"])
    out = known.groupBy(score_band(F.col("ml_score")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("sample_size"), F.avg("ml_score").alias("mean_score"), F.avg("forward_excess_return").alias("mean_forward_return"),
        F.avg("actual_out").alias("return_label_rate"), F.avg("actual_risk").alias("drawdown_label_rate"),
    )
    means = [F.max(F.when(F.col("bucket") == b, F.col("mean_forward_return"))) for b in BANDS]
    return out.crossJoin(F.broadcast(out.agg(shape(means).alias("monotonicity_result"))))


def inversion(scores: DataFrame, minimum: int = BUCKET) -> DataFrame:
    """Spread of the score against the spread of (max - score)."""
    known = scores.dropna(subset=["ml_score", "forward_excess_return"]).select("ml_score", "forward_excess_return")
    top = known.agg(F.max("ml_score").alias("_max"))
    pairs = F.array(
        F.struct(F.lit("original").alias("score_direction"), F.col("ml_score").alias("s")),
        F.struct(F.lit("inverted").alias("score_direction"), (F.col("_max") - F.col("ml_score")).alias("s")),
    )
    rows = known.crossJoin(F.broadcast(top)).select("forward_excess_return", F.inline(pairs))
    out = rows.groupBy("score_direction").agg(F.count(F.lit(1)).alias("sample_size"), *band_aggregates(F.col("s"), "forward_excess_return", minimum, "m"))
    out = out.withColumn("sp", spread("m"))
    refs = out.agg(F.max(F.when(F.col("score_direction") == "original", F.col("sp"))).alias("o"), F.max(F.when(F.col("score_direction") == "inverted", F.col("sp"))).alias("i"))
    better = (
        F.when(F.col("o").isNull() | F.col("i").isNull(), "insufficient").when(F.col("o") > F.col("i") + TOLERANCE, "original")
        .when(F.col("i") > F.col("o") + TOLERANCE, "inverted").otherwise("similar")
    )
    known_spread = F.col("sp").isNotNull()
    return out.crossJoin(F.broadcast(refs)).select(
        "score_direction", "sample_size", F.when(known_spread, F.col("m_high")).alias("top_bucket_forward_return"),
        F.when(known_spread, F.col("m_low")).alias("bottom_bucket_forward_return"), F.col("sp").alias("top_minus_bottom_spread"), better.alias("better_forward_return_separation"),
    )


def _ranked_thirds(scores: DataFrame, signals: dict[str, Column], minimum: int) -> DataFrame:
    """Rank terciles of several signals at once (signals become rows)."""
    entries = F.array(*[F.struct(F.lit(n).alias("signal"), c.alias("s")) for n, c in signals.items()])
    rows = scores.select("date", "ticker", "forward_excess_return", "actual_out", "actual_risk", F.inline(entries)).dropna(subset=["s", "forward_excess_return"])
    ranked = with_positions(rows, ["signal"], "s", DATE_TIES).withColumn("_b", rank_bucket(F.col("pos"), F.col("group_size"), 3))
    aggregates = [F.count(F.lit(1)).alias("sample_size"), F.count_distinct("s").alias("_distinct")]
    for i, b in enumerate(("low", "mid", "high")):
        inside = F.col("_b") == i
        aggregates += [
            F.when(F.count_if(inside) >= minimum, mean_in(inside, "forward_excess_return")).alias(f"{b}_bucket_forward_excess_return"),
            mean_in(inside, "actual_out").alias(f"{b}_bucket_label_rate"),
            mean_in(inside, "actual_risk").alias(f"{b}_bucket_drawdown_event_rate"),
        ]
    out = ranked.groupBy("signal").agg(*aggregates)
    lo, mid, hi = (F.col(f"{b}_bucket_forward_excess_return") for b in ("low", "mid", "high"))
    known = lo.isNotNull() & mid.isNotNull() & hi.isNotNull()
    return out.withColumns({"high_minus_low_spread": hi - lo, "monotonicity": F.when(known, shape([lo, mid, hi])).otherwise("insufficient")})


def probability_direction(scores: DataFrame, minimum: int = BUCKET) -> DataFrame:
    signals = {
        "raw probability": F.col("probability_out"),
        "inverted probability": 1 - F.col("probability_out"),
        "current ML Score": F.col("ml_score"),
    }
    return _ranked_thirds(scores, signals, minimum).select(
        "signal", "sample_size", "low_bucket_forward_excess_return", "mid_bucket_forward_excess_return", "high_bucket_forward_excess_return",
        "high_minus_low_spread", "monotonicity", F.col("low_bucket_label_rate").alias("actual_label_rate_low_bucket"),
        F.col("high_bucket_label_rate").alias("actual_label_rate_high_bucket"),
    )


def risk_haircut(opportunity: Column, risk: Column) -> Column:
    return opportunity * F.when(risk >= 0.60, 0.70).when(risk >= 0.40, 0.85).otherwise(1.0)


def formula_candidates(scores: DataFrame, minimum: int = BUCKET) -> DataFrame:
    """Five score formulas on the same rank terciles."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("probability_out")))
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("probability_risk")))
    formulas = {
        "raw_probability": 100 * p,
        "sqrt_opportunity_only": 100 * F.sqrt(p),
        "current_production_score": 100 * p,
        "light_risk_penalty": 100 * (0.85 * F.sqrt(p) + 0.15 * (1 - risk)),
        "risk_haircut_score": risk_haircut(100 * F.sqrt(p), risk),
    }
    out = _ranked_thirds(scores, formulas, minimum)
    s, no = F.col("high_minus_low_spread"), F.lit(False)
    label_up = F.coalesce(F.col("high_bucket_label_rate") > F.col("low_bucket_label_rate") + TOLERANCE, F.lit(True))
    calm = F.coalesce(F.col("high_bucket_drawdown_event_rate") <= F.col("low_bucket_drawdown_event_rate") + 0.20, F.lit(True))
    read = (
        F.when(s.isNull() | (F.col("monotonicity") == "insufficient"), "insufficient data")
        .when((s < -TOLERANCE) | (F.col("monotonicity") == "inverted"), "candidate is inverted")
        .when((s > TOLERANCE) & (F.col("monotonicity") == "aligned") & label_up & calm, "candidate looks strong")
        .when((s <= TOLERANCE) | ~label_up, "candidate looks weak")
        .otherwise("candidate is mixed")
    )
    return out.select(
        F.col("signal").alias("candidate_name"), "sample_size", "low_bucket_forward_excess_return", "mid_bucket_forward_excess_return",
        "high_bucket_forward_excess_return", "high_minus_low_spread", "monotonicity", "low_bucket_label_rate", "high_bucket_label_rate",
        "low_bucket_drawdown_event_rate", "high_bucket_drawdown_event_rate", read.alias("interpretation"),
    )


def joint_grid(scores: DataFrame, minimum: int = BUCKET) -> DataFrame:
    """Rank-median opportunity x risk cells and the joint read; settled input."""
    known = scores.dropna(subset=["probability_out", "probability_risk", "forward_excess_return"])
    a = with_positions(known, [], "probability_out", DATE_TIES)
    a = a.withColumn("opportunity_bucket", F.when(rank_bucket(F.col("pos"), F.col("group_size"), 2) == 0, "Low opportunity").otherwise("High opportunity")).drop("pos", "group_size")
    b = with_positions(a, [], "probability_risk", DATE_TIES)
    b = b.withColumn("risk_bucket", F.when(rank_bucket(F.col("pos"), F.col("group_size"), 2) == 0, "Low risk").otherwise("High risk"))
    cells = b.groupBy("opportunity_bucket", "risk_bucket").agg(
        F.count(F.lit(1)).alias("sample_size"), F.avg("forward_excess_return").alias("avg_forward_excess_return"),
        F.avg("forward_drawdown").alias("avg_forward_drawdown"), F.avg("actual_risk").alias("drawdown_event_rate"),
    )

    def cell(o: str, r: str, c: str) -> Column:
        return F.max(F.when((F.col("opportunity_bucket") == f"{o} opportunity") & (F.col("risk_bucket") == f"{r} risk"), F.col(c)))

    returns = cell("High", "Low", "avg_forward_excess_return") - cell("Low", "High", "avg_forward_excess_return") > TOLERANCE
    drop = cell("High", "High", "avg_forward_drawdown") < cell("High", "Low", "avg_forward_drawdown") - TOLERANCE
    events = cell("High", "High", "drawdown_event_rate") - cell("High", "Low", "drawdown_event_rate") > TOLERANCE
    risk = F.coalesce(drop, F.lit(False)) | F.coalesce(events, F.lit(False))
    read = cells.agg(
        F.when((F.count(F.lit(1)) < 4) | (F.min("sample_size") < minimum) | returns.isNull(), "insufficient data to compare")
        .when(returns & risk, "joint validation supports separate opportunity and risk signals")
        .when(~returns & ~risk, "joint validation does not support the combined signal")
        .otherwise("joint validation is mixed").alias("joint_validation_result")
    )
    grid = [F.struct(F.lit(f"{o} opportunity").alias("opportunity_bucket"), F.lit(f"{r} risk").alias("risk_bucket")) for o in ("High", "Low") for r in ("Low", "High")]
    full = read.select("joint_validation_result", F.inline(F.array(*grid)))
    return full.join(cells, ["opportunity_bucket", "risk_bucket"], "left").withColumn("sample_size", F.coalesce("sample_size", F.lit(0)))


def target_versions(rows: DataFrame, minimum: int = BUCKET) -> DataFrame:
    """Separation of each target version by its own probability, relative to v1.

    ``rows``: settled ``(target_version, date, ticker, probability, target)``.
    """
    known = rows.dropna(subset=["probability", "target"])
    ranked = with_positions(known, ["target_version"], "probability", DATE_TIES).withColumn("_b", rank_bucket(F.col("pos"), F.col("group_size"), 3))
    aggregates = [F.count(F.lit(1)).alias("sample_size")]
    for i, b in enumerate(("low", "middle", "high")):
        aggregates += [mean_in(F.col("_b") == i, "target").alias(f"{b}_bucket_target"), F.count_if(F.col("_b") == i).alias(f"_n_{b}")]
    out = ranked.groupBy("target_version").agg(*aggregates)
    enough = (F.col("_n_low") >= minimum) & (F.col("_n_high") >= minimum)
    lo, mid, hi = (F.col(f"{b}_bucket_target") for b in ("low", "middle", "high"))
    out = out.withColumns({"high_minus_low_spread": F.when(enough, hi - lo), "monotonicity": F.when(enough, shape([lo, mid, hi])).otherwise("insufficient")})
    order = F.when(F.col("monotonicity") == "aligned", 3).when(F.col("monotonicity").isin("flat", "mixed"), 2).when(F.col("monotonicity") == "inverted", 1).otherwise(0)
    out = out.withColumn("_o", order)
    v1 = out.filter("target_version = 'v1'").select(F.col("high_minus_low_spread").alias("baseline_spread"), F.col("_o").alias("_o1"))
    s, s1, o, o1 = F.col("high_minus_low_spread"), F.col("baseline_spread"), F.col("_o"), F.col("_o1")
    read = (
        F.when(F.col("target_version") == "v1", "reference").when(s.isNull() | s1.isNull(), "insufficient data")
        .when(((s > s1 + TOLERANCE) & (o >= o1)) | ((s + TOLERANCE >= s1) & (o > o1)), F.concat("target_version", F.lit(" looks better")))
        .when((s + TOLERANCE < s1) | (o < o1), F.concat("target_version", F.lit(" looks worse")))
        .otherwise(F.concat("target_version", F.lit(" looks similar")))
    )
    return out.crossJoin(F.broadcast(v1)).select(
        "target_version", "sample_size", "low_bucket_target", "middle_bucket_target", "high_bucket_target", "high_minus_low_spread",
        "monotonicity", "baseline_spread", read.alias("relative_result"),
    )


GATES = (
    "no_gate_baseline", "exclude_inverted_regimes", "exclude_inverted_and_insufficient_regimes",
    "require_positive_realised_bucket_spread", "drawdown_risk_not_extreme", "combined_conservative_gate",
)


def gated(scores: DataFrame, reliability: DataFrame) -> DataFrame:
    """Score rows repeated once per gate with a ``pass`` flag; regimes are few."""
    known = scores.dropna(subset=["ml_score", "actual_out", "probability_out", "forward_excess_return", "actual_risk", "probability_risk"])
    lookup = reliability.select("regime", F.col("classification").alias("_c"), F.col("bucket_spread").alias("_s"))
    rows = known.join(F.broadcast(lookup), "regime", "left")
    no = F.lit(False)
    sound = F.coalesce(~F.col("_c").isin("inverted", "insufficient_sample"), no)
    positive, calm = F.coalesce(F.col("_s") > TOLERANCE, no), F.col("probability_risk") < 0.70
    masks = [F.lit(True), F.coalesce(F.col("_c") != "inverted", no), sound, positive, calm, sound & positive & calm]
    pairs = F.array(*[F.struct(F.lit(g).alias("gate_name"), m.alias("pass")) for g, m in zip(GATES, masks)])
    return rows.select("regime", "ml_score", "actual_out", "probability_out", "actual_risk", "forward_excess_return", F.inline(pairs))


def _gate_side(flag: Column, name: str, minimum: int) -> list[Column]:
    band = score_band(F.col("ml_score"))
    hi, lo = flag & (band == "High"), flag & (band == "Low")
    error = F.col("probability_out") - F.col("actual_out")
    enough = (F.count_if(hi) >= minimum) & (F.count_if(lo) >= minimum)
    return [
        F.count_if(flag).alias(f"{name}_count"),
        mean_in(flag, "actual_out").alias(f"{name}_positive_rate"),
        mean_in(flag, "forward_excess_return").alias(f"{name}_avg_forward_excess_return"),
        mean_in(flag, "actual_risk").alias(f"{name}_drawdown_rate"),
        F.when(enough, mean_in(hi, "forward_excess_return") - mean_in(lo, "forward_excess_return")).alias(f"{name}_bucket_spread"),
        F.avg(F.when(flag, error * error)).alias(f"{name}_brier"),
    ]


def gate_metrics(rows: DataFrame, samples: int = SAMPLES, minimum: int = BUCKET) -> DataFrame:
    """Pass and fail groups of every gate, judged against the no-gate row."""
    out = rows.groupBy("gate_name").agg(
        F.count(F.lit(1)).alias("sample_count"), *_gate_side(F.col("pass"), "pass", minimum), *_gate_side(~F.col("pass"), "fail", minimum)
    ).withColumn("retention_rate", F.col("pass_count") / F.col("sample_count"))
    base = out.filter(F.col("gate_name") == GATES[0]).select(
        F.col("pass_avg_forward_excess_return").alias("_r"), F.col("pass_positive_rate").alias("_p"), F.col("pass_drawdown_rate").alias("_d")
    )
    no, is_base = F.lit(False), F.col("gate_name") == GATES[0]
    thin = F.when(is_base, F.col("pass_count") < samples).otherwise((F.col("pass_count") < samples) | (F.col("fail_count") < samples))
    few = (F.col("retention_rate") < 0.15) | (F.col("pass_count") < 2 * samples)
    better = F.coalesce(F.col("pass_avg_forward_excess_return") > F.col("_r") + TOLERANCE, no) | F.coalesce(F.col("pass_positive_rate") > F.col("_p") + TOLERANCE, no)
    harm = (
        F.coalesce(F.col("pass_avg_forward_excess_return") < F.col("_r") - TOLERANCE, no)
        | F.coalesce(F.col("pass_drawdown_rate") > F.col("_d") + 0.05, no)
        | F.coalesce(F.col("pass_bucket_spread") < -TOLERANCE, no)
    )
    return out.crossJoin(F.broadcast(base)).withColumns(
        {
            "improvement_flag": ~thin & ~is_base & better,
            "overfit_warning_flag": ~thin & ~is_base & few,
            "insufficient_sample_flag": thin,
            "classification": F.when(thin, "insufficient_sample").when(is_base, "mixed").when(harm, "harmful")
            .when(better & few, "unstable").when(better, "useful").otherwise("mixed"),
        }
    ).drop("_r", "_p", "_d")


def gate_by_regime(rows: DataFrame, gates: DataFrame, samples: int = SAMPLES) -> DataFrame:
    out = rows.groupBy("gate_name", "regime").agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if("pass").alias("pass_count"), mean_in(F.col("pass"), "actual_out").alias("pass_positive_rate"),
        mean_in(F.col("pass"), "forward_excess_return").alias("pass_avg_forward_excess_return"), mean_in(F.col("pass"), "actual_risk").alias("pass_drawdown_rate"),
    ).withColumn("retention_rate", F.col("pass_count") / F.col("sample_count"))
    labels = gates.select("gate_name", F.col("classification").alias("_c"))
    return out.join(F.broadcast(labels), "gate_name").withColumn(
        "classification", F.when(F.col("pass_count") < samples, "insufficient_sample").otherwise(F.col("_c"))
    ).drop("_c")


def calibration_quality(table: DataFrame, overall: DataFrame, minimum: int = 20) -> DataFrame:
    """Weighted gaps and monotonicity of a calibration table (at most ``bins`` rows)."""
    gap = F.col("observed_rate") - F.col("average_probability")
    n = F.sum("count")
    ordered = F.sort_array(F.collect_list(F.struct("average_probability", "observed_rate")))
    rates = F.transform(ordered, lambda s: s["observed_rate"])
    rising = F.forall(
        F.zip_with(F.slice(rates, 2, F.greatest(F.size(rates) - 1, F.lit(0))), F.slice(rates, 1, F.greatest(F.size(rates) - 1, F.lit(0))), lambda b, a: b - a),
        lambda d: d >= -1e-12,
    )
    out = table.filter("count > 0").agg(
        n.alias("sample_size"),
        (F.sum(F.col("average_probability") * F.col("count")) / n).alias("mean_predicted_risk"),
        (F.sum(F.col("observed_rate") * F.col("count")) / n).alias("observed_drawdown_rate"),
        (F.sum(F.abs(gap) * F.col("count")) / n).alias("mean_absolute_calibration_error"),
        F.max(F.abs(gap)).alias("max_bucket_calibration_gap"),
        F.when((F.count(F.lit(1)) >= 2) & rising, "higher buckets aligned").otherwise("not clearly monotonic").alias("monotonicity"),
    ).withColumn("calibration_gap", F.col("observed_drawdown_rate") - F.col("mean_predicted_risk"))
    return out.crossJoin(F.broadcast(overall.select("brier_score"))).withColumn(
        "interpretation",
        F.when(F.col("sample_size") < minimum, "insufficient").when(F.col("monotonicity") == "not clearly monotonic", "not monotonic")
        .when(F.col("calibration_gap") > 0.10, "underestimates").when(F.col("calibration_gap") < -0.10, "overestimates")
        .when((F.col("mean_absolute_calibration_error") > 0.15) | (F.col("max_bucket_calibration_gap") > 0.25), "weak").otherwise("aligned"),
    )


def drawdown_by_regime(scores: DataFrame, by: str = "regime", samples: int = SAMPLES, classes: int = CLASS, minimum: int = BUCKET) -> DataFrame:
    """Drawdown probability calibration per regime; settled input."""
    clipped = scores.withColumn("_p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("probability_risk")))).dropna(subset=[by, "_p", "actual_risk"])
    base = binary_metrics(clipped, [by], "actual_risk", "_p")
    band = third(F.col("_p"))
    aggregates = [F.count_distinct("ticker").alias("ticker_count"), F.count_distinct("fold").alias("fold_count")]
    for b in ("low", "mid", "high"):
        aggregates += [mean_in(band == b, "actual_risk").alias(f"{b}_bucket_event_rate"), F.count_if(band == b).alias(f"_n_{b}")]
    worst = worst_group(clipped, [by], "ticker", "actual_risk", "_p", "worst_ticker", minimum).drop("worst_ticker_brier")
    out = base.join(clipped.groupBy(by).agg(*aggregates), by).join(worst, by, "left")
    rates = [F.col(f"{b}_bucket_event_rate") for b in ("low", "mid", "high")]
    known = rates[0].isNotNull() & rates[1].isNotNull() & rates[2].isNotNull()
    out = out.withColumns({"bucket_spread": rates[2] - rates[0], "monotonicity": F.when(known, shape(rates)).otherwise("insufficient")})
    events, s = F.col("positive_count"), F.col("bucket_spread")
    thin = (
        (F.col("sample_count") < samples) | (events < classes) | (F.col("sample_count") - events < classes)
        | (F.col("_n_low") < minimum) | (F.col("_n_high") < minimum) | F.col("pr_auc").isNull() | s.isNull()
    )
    useful = (
        (F.col("monotonicity") == "aligned") & (s > TOLERANCE) & (F.col("pr_auc") > F.col("positive_rate") + 0.02)
        & (F.abs("calibration_gap") <= 0.15) & (F.col("brier_score") <= 0.25)
    )
    return out.select(
        by, "sample_count", "ticker_count", "fold_count", F.col("positive_rate").alias("event_prevalence"), F.col("mean_probability").alias("mean_predicted_risk"),
        "calibration_gap", "brier_score", "pr_auc", "low_bucket_event_rate", "mid_bucket_event_rate", "high_bucket_event_rate", "bucket_spread", "monotonicity", "worst_ticker",
        F.when(thin, "insufficient_evidence").when((F.col("monotonicity") == "inverted") | (s < -TOLERANCE), "inverted")
        .when(useful, "usable_risk_signal").otherwise("miscalibrated").alias("classification"),
    )
