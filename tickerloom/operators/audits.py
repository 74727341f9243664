"""Label, feature, importance and validation audits."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom import fixed
from tickerloom.functions.buckets import edge_bucket
from tickerloom.functions.stats import correlation, over
from tickerloom.operators.metrics import concentration, quantile_bucketed
from tickerloom.plans.blocks import PARTIAL, summed
from tickerloom.plans.ranking import with_mask_ranks, with_running_totals
from tickerloom.plans.storage import passing

LEAKY = re.compile(r"^(label_|forward_|benchmark_forward_)")


# --- labels -----------------------------------------------------------------


def class_balance(rate: Column, sample: Column, minimum: int = 20) -> Column:
    return (
        F.when((sample < minimum) | rate.isNull(), "insufficient").when((rate <= 0) | (rate >= 1), "single class")
        .when(rate < 0.10, "sparse positive").when(rate > 0.90, "highly common positive").otherwise("balanced")
    )


def label_audit(panel: DataFrame, labels: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Prevalence of every label overall and per group value, in one grouped pass.

    Rows with ``dimension = 'overall'`` are the totals; group rows carry the
    material-spread flag of their dimension.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("v")) for c in labels])
    scopes = F.array(
        F.struct(F.lit("overall").alias("dimension"), F.lit("ALL").alias("group")),
        *[F.struct(F.lit(g).alias("dimension"), F.trim(F.col(g).cast("string")).alias("group")) for g in groups],
    )
    rows = panel.select(F.inline(entries), *groups).select("label", "v", F.inline(scopes)).filter("`group` <> ''")
    out = rows.groupBy("dimension", "group", "label").agg(
        F.count("v").alias("sample_size"), F.count_if(F.col("v") == 1).alias("positive_count"), F.count_if(F.col("v").isNull()).alias("missing_count"),
    ).withColumn("positive_rate", F.col("positive_count") / F.nullif("sample_size", F.lit(0)))
    out = out.filter((F.col("dimension") == "overall") | (F.col("sample_size") > 0))
    range_ = out.groupBy("dimension", "label").agg((F.max("positive_rate") - F.min("positive_rate")).alias("_r"), F.count("positive_rate").alias("_k"))
    return out.join(range_, ["dimension", "label"]).select(
        "dimension", "group", "label", "sample_size", "positive_count", "positive_rate", "missing_count",
        (F.col("missing_count") / (F.col("missing_count") + F.col("sample_size"))).alias("missing_rate"),
        class_balance(F.col("positive_rate"), F.col("sample_size")).alias("class_balance"),
        F.coalesce((F.col("dimension") != "overall") & (F.col("_k") >= 2) & (F.col("_r") >= 0.25), F.lit(False)).alias("varies_materially"),
    )


def threshold_sensitivity(
    panel: DataFrame, h: int = 20, gains: Sequence[float] = (0.0, 0.01, 0.02, 0.03, 0.05), drops: Sequence[float] = (-0.05, -0.10, -0.15, -0.20)
) -> DataFrame:
    """All thresholds are conditional counts of one aggregate."""
    up, down = F.col(f"forward_{h}d_excess_return"), F.col(f"forward_{h}d_drawdown")
    cases = [("outperformance", t, up, up > t) for t in gains] + [("drawdown_risk", t, down, down < t) for t in drops]
    one = panel.agg(*[F.count(c).alias(f"n{i}") for i, (_, _, c, _) in enumerate(cases)], *[F.count_if(p).alias(f"p{i}") for i, (*_, p) in enumerate(cases)])
    rows = [
        F.struct(
            F.lit(f).alias("target_family"), F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("sample_size"), F.col(f"p{i}").alias("positive_count"),
            (F.col(f"p{i}") / F.nullif(F.col(f"n{i}"), F.lit(0))).alias("positive_rate"),
        )
        for i, (f, t, _, _) in enumerate(cases)
    ]
    return one.select(F.inline(F.array(*rows))).filter("sample_size > 0")


def label_overlap(panel: DataFrame, h: int = 20) -> DataFrame:
    a, b = F.col(f"label_outperform_{h}d"), F.col(f"label_drawdown_risk_{h}d")
    cells = panel.filter(a.isin(0.0, 1.0) & b.isin(0.0, 1.0)).groupBy(a.cast("long").alias("outperform_label"), b.cast("long").alias("drawdown_risk_label"))
    counted = cells.agg(F.count(F.lit(1)).alias("sample_size"))
    return counted.withColumn("share_of_total", F.col("sample_size") / F.sum("sample_size").over(Window.partitionBy()))


# --- features ---------------------------------------------------------------

# Family keywords, first match wins.
FAMILIES = (
    ("momentum / return", ("return", "momentum", "roc")),
    ("trend / moving average", ("ma_", "moving_average", "sma", "ema", "trend", "dist_ma")),
    ("volatility", ("volatility", "atr", "drawdown")),
    ("relative strength / benchmark-relative", ("rs_", "relative_strength", "benchmark", "excess")),
    ("volume / liquidity", ("volume", "liquidity", "turnover")),
    ("RSI / technical", ("rsi", "macd", "stoch", "technical")),
    ("Fourier / wavelet / complex transform", ("fourier", "wavelet")),
)
# Preferred transform features and their raw counterparts.
DERIVED = (
    "fourier_cycle_clarity", "fourier_cycle_strength", "fourier_noise_diffusion", "wavelet_clean_trend",
    "wavelet_trend_quality", "wavelet_noise_pressure", "wavelet_medium_long_energy_share",
)
RAW = ("fourier_energy_concentration", "fourier_spectral_entropy", "wavelet_trend_return", "wavelet_short_noise_intensity")


def family(feature: Column) -> Column:
    low, out = F.lower(feature), None
    for name, words in FAMILIES:
        hit = low.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown / other")


def require_no_leak(columns: Sequence[str]) -> None:
    leaky = [c for c in columns if LEAKY.match(c)]
    if leaky:
        raise ValueError(f"label columns cannot be features: {leaky}")


def known_features(panel: DataFrame) -> list[str]:
    """Numeric columns that some feature group names, usable or not."""
    numeric = [c for c, t in panel.dtypes if t in ("double", "float", "int", "bigint") and c.startswith((*fixed.TECHNICAL_PREFIXES, "fourier_", "wavelet_"))]
    return [c for c in numeric if c not in fixed.NOT_FEATURES and c not in fixed.PRICE_FIELDS and not LEAKY.match(c)]


def feature_columns(panel: DataFrame, group: str = "all", prune: bool = True) -> list[str]:
    """Usable numeric columns of a feature group; one aggregate finds the all-NULL ones."""
    known = known_features(panel)
    technical = [c for c in known if c.startswith(fixed.TECHNICAL_PREFIXES)]
    parts = {"technical": [], "technical_fourier": ["fourier_"], "technical_wavelet": ["wavelet_"], "all": ["fourier_", "wavelet_"]}
    if group not in parts:
        raise ValueError(f"group must be one of {sorted(parts)}")
    wanted = technical + [c for p in parts[group] for c in known if c.startswith(p)]
    filled = panel.agg(*[F.count(c).alias(c) for c in wanted]).first()
    wanted = [c for c in wanted if filled[c]]
    if prune:
        for p in parts[group]:
            mine = [c for c in wanted if c.startswith(p)]
            gone = {d for d, *_ in redundant(panel, mine)}
            wanted = [c for c in wanted if c not in gone]
    return wanted


def correlation_matrix(panel: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pairwise-complete correlations of all column pairs; NaN with a constant side or less than two rows.

    A masked Gram matrix: tasks multiply values and masks of known values, centered by
    the columns' means, and the products are added up over a tree of shuffles.  The
    result grows with the square of the columns, not with the rows.
    """
    columns, width = list(columns), len(columns)
    means = panel.agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c) for c in columns]).first()
    center = np.array([float(means[c] or 0.0) for c in columns])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - center
            known = np.isfinite(x).astype(float)
            x = np.where(known > 0, x, 0.0)
            total += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["key", "data"])

    rows = panel.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    parts = rows.rdd.getNumPartitions()
    found = summed(rows.mapInArrow(partial, PARTIAL), parts, lambda key, total: (key, total.tobytes()), PARTIAL).first()
    if found is None:
        return np.full((width, width), np.nan)
    n, s, q, xy = np.frombuffer(found.data, float).reshape(4, width, width)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = q / n - (s / n) ** 2
        spread = np.where(spread > 1e-12 * (q / n), spread, np.nan)
        return np.where(n > 1, (xy / n - (s / n) * (s.T / n)) / np.sqrt(spread * spread.T), np.nan)


def correlation_pairs(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """|correlation| of each column pair that has one."""
    matrix = np.abs(correlation_matrix(panel, columns))
    rows = [(a, b, float(matrix[i, j])) for (i, a), (j, b) in combinations(enumerate(columns), 2) if not np.isnan(matrix[i, j])]
    return panel.sparkSession.createDataFrame(rows, "feature_1 string, feature_2 string, abs_correlation double")


def first_available(panel: DataFrame, *candidates: Sequence[str]) -> list[str | None]:
    """For each list of names, the first column that exists and has a known value; one pass for all lists."""
    names = {c for group in candidates for c in group if c in panel.columns}
    filled = panel.agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in sorted(names)]).first() if names else {}
    return [next((c for c in group if c in names and filled[c]), None) for group in candidates]


def ranked_pairs(panel: DataFrame, columns: Sequence[str], threshold: float = 0.98) -> DataFrame:
    """``keeper, loser, abs_correlation`` of the pairs at or above the threshold, strongest first.

    Derived features outrank raw ones, those outrank single components, and all
    others come last; inside a class the first name stays.
    """

    def standing(c: str) -> Column:
        part = F.col(c).rlike(r"^(fourier_(amp|freq|period)_\d+|wavelet_energy_scale_\d+)$")
        level = F.when(F.col(c).isin(*DERIVED), 0).when(F.col(c).isin(*RAW), 1).when(part, 2).otherwise(3)
        return F.struct(level.alias("level"), F.col(c).alias("name"))

    x, y = standing("feature_1"), standing("feature_2")
    strong = correlation_pairs(panel, columns).filter(F.col("abs_correlation") >= threshold)
    sided = strong.select(F.least(x, y).alias("k"), F.greatest(x, y).alias("l"), "abs_correlation")
    return sided.orderBy(F.desc("abs_correlation"), "k", "l").select(F.col("k.name").alias("keeper"), F.col("l.name").alias("loser"), "abs_correlation")


def redundant(panel: DataFrame, columns: Sequence[str], threshold: float = 0.98) -> list[tuple[str, str, float]]:
    """``(dropped, kept, correlation)``: each pair merges two features that still stand alone or lead a group.

    The list of pairs depends on the columns, not on the rows, so the driver merges it.
    """
    if len(columns) < 2:
        return []
    members = {c: [] for c in columns}  # leader -> what it replaced
    for pair in ranked_pairs(panel, columns, threshold).collect():
        if pair.keeper in members and pair.loser in members:
            members[pair.keeper] += [(pair.loser, pair.abs_correlation), *members.pop(pair.loser)]
    return [(name, leader, r) for leader, group in members.items() for name, r in group]


def long_features(panel: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])
    return panel.select(*keep, F.inline(entries))


def feature_profile(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing rate and dominance of the most common value per feature."""
    values = long_features(panel, features, []).groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("v").isNotNull()
    return values.groupBy("feature").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("valid"), F.count("v").alias("distinct_values"),
        F.max(F.when(known, F.col("n"))).alias("_top"),
    ).select(
        "feature", family(F.col("feature")).alias("family"), F.col("valid").alias("valid_sample_count"), (1 - F.col("valid") / F.col("rows")).alias("missing_rate"), "distinct_values",
        ((F.col("valid") == 0) | (F.col("distinct_values") <= 1) | F.coalesce(F.col("_top") / F.nullif("valid", F.lit(0)) >= 0.95, F.lit(False))).alias("near_constant"),
    )


def feature_inventory(profile: DataFrame, panel: DataFrame, requested: int) -> DataFrame:
    one = profile.agg(
        F.count(F.lit(1)).alias("numeric_feature_count"), F.avg("missing_rate").alias("mean_missing_rate"),
        F.count_if(F.col("missing_rate") >= 0.30).alias("high_missing_feature_count"), F.count_if("near_constant").alias("constant_or_near_constant_feature_count"),
    )
    return one.crossJoin(F.broadcast(panel.agg(F.count(F.lit(1)).alias("sample_size")))).withColumns(
        {"feature_count": F.lit(requested), "sample_to_feature_ratio": F.col("sample_size") / F.lit(requested)}
    )


def family_summary(profile: DataFrame) -> DataFrame:
    total = profile.agg(F.count(F.lit(1)).alias("_t"))
    return profile.groupBy("family").agg(
        F.count(F.lit(1)).alias("feature_count"), F.array_join(F.slice(F.sort_array(F.collect_list("feature")), 1, 3), ", ").alias("example_features")
    ).crossJoin(F.broadcast(total)).withColumn("share_of_features", F.col("feature_count") / F.col("_t")).drop("_t")


def feature_warnings(profile: DataFrame, inventory: DataFrame) -> DataFrame:
    """Warning rows that apply, with the number of features concerned."""
    i = inventory
    top = family_summary(profile).agg(F.max("share_of_features").alias("top_share"))
    complex_ = profile.agg(F.count_if(F.col("family").startswith("Fourier")).alias("complex"))
    one = i.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(complex_))
    ratio = F.col("sample_to_feature_ratio")
    cases = [
        ("high_missing", F.col("high_missing_feature_count")),
        ("near_constant", F.col("constant_or_near_constant_feature_count")),
        ("low_sample_ratio", F.when(ratio < 10, F.col("feature_count")).otherwise(0)),
        ("family_concentration", F.when(F.col("top_share") >= 0.60, F.col("feature_count")).otherwise(0)),
        ("complex_features", F.when(ratio < 20, F.col("complex")).otherwise(0)),
    ]
    rows = [F.struct(F.lit(n).alias("warning"), c.cast("long").alias("feature_count")) for n, c in cases]
    return one.select(F.inline(F.array(*rows))).filter("feature_count > 0")


def _label_spearman(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``r_<label>`` per feature: correlation of the average rank of ``v`` among rows that know the 0/1 label with it.

    Rows of one value share their rank, so one ordering of the distinct values with
    their counts serves all labels.
    """
    counts = [F.count(c).alias(f"n_{c}") for c in labels] + [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s_{c}") for c in labels]
    ranked = with_running_totals(rows.groupBy("feature", "v").agg(*counts), ["feature"], "v", [f"n_{c}" for c in labels])
    moments = []
    for c in labels:
        n, rank = F.col(f"n_{c}"), F.col(f"below_n_{c}") + (F.col(f"n_{c}") + 1) / 2.0
        moments += [F.sum(n).alias(f"_n_{c}"), F.sum(f"s_{c}").alias(f"_s_{c}"), F.sum(n * rank * rank).alias(f"_q_{c}"), F.sum(F.col(f"s_{c}") * rank).alias(f"_p_{c}")]
    found = []
    for c in labels:
        n, s, q, p = (F.col(f"_{x}_{c}") for x in "nsqp")
        mean = (n + 1) / 2.0
        spread = (q - n * mean * mean) * (s - over(s * s, n))
        found.append(over(p - s * mean, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias(f"r_{c}"))
    return ranked.groupBy("feature").agg(*moments).select("feature", *found)


def _rank_link(rank: str, x: Column, where: Column) -> Column:
    """Correlation of a rank with ``x`` over some rows; NULL when a side is constant."""
    return correlation(F.when(where, F.col(rank)), x)


def _signal_of(panel: DataFrame, feature: str, target: str, labels: Sequence[str]) -> DataFrame | None:
    """One row for a feature (a column ``v``), or none: counts, rank correlations and outer quintile means.

    ``panel`` has the rank of the target among rows that know the feature in ``_t``.  One ordering of the feature's values
    gives its ranks among the rows that know the target or a label, and the quintile edges.
    """
    known = [F.col(c).isNotNull().alias(f"_k{k}") for k, c in enumerate((target, *labels))]
    masks = ["_all", *(f"_k{k}" for k in range(1 + len(labels)))]
    rows = with_mask_ranks(panel.filter("v IS NOT NULL").select("v", target, "_t", *labels, F.lit(True).alias("_all"), *known), "v", masks)
    shape = rows.agg(
        F.count(target).alias("n"), F.round(F.sum(1 / F.col("same__all"))).cast("long").alias("values"), _rank_link("rank__k0", F.col("_t"), F.col("_k0")).alias("r"),
        *[F.abs(_rank_link(f"rank__k{k}", F.col(c), F.col(f"_k{k}"))).alias(f"r{k}") for k, c in enumerate(labels, 1)],
    ).first()
    if not shape["n"]:
        return None
    places = [(shape["n"] - 1) * float(i / 5) for i in range(6)]
    upto = F.col("rank__k0") + (F.col("same__k0") - 1) / 2.0  # place of the last row with the value
    wanted = sorted({int(p) + d for p in places for d in (1, 2) if int(p) + d <= shape["n"]})
    found = rows.filter("_k0").agg(*[F.min(F.when(upto >= k, F.col("v"))).alias(str(k)) for k in wanted]).first().asDict()
    points = []
    for p in places:
        low = found[str(int(p) + 1)]
        points.append(low + (found[str(min(int(p) + 2, shape["n"]))] - low) * (p - int(p)))
    cut = rows.filter("_k0").select("v", target).withColumn("_q", edge_bucket(F.col("v"), F.array(*[F.lit(x) for x in points])))
    ends = cut.groupBy("_q").agg(F.avg(target).alias("m")).agg(F.min_by("m", "_q").alias("bottom_quantile_target_mean"), F.max_by("m", "_q").alias("top_quantile_target_mean"))
    facts = [F.lit(shape[c]).cast(t) for c, t in (("n", "long"), ("r", "double"), ("values", "long"), *((f"r{k}", "double") for k in range(1, 1 + len(labels))))]
    return ends.select(F.lit(feature), *facts, "bottom_quantile_target_mean", "top_quantile_target_mean")


def feature_signal(panel: DataFrame, features: Sequence[str], h: int = 20, minimum: int = 20) -> DataFrame:
    """Univariate rank correlation and quintile spread of every feature; settled input.

    The target is ordered once for all features, among whose known rows it is ranked; then one feature after the other, so
    that a single ordering lies on disk at a time.
    """
    target, up, down = f"forward_{h}d_excess_return", f"label_outperform_{h}d", f"label_drawdown_risk_{h}d"
    spark = panel.sparkSession
    values = [F.col(c).cast("double").alias(f"_v{k}") for k, c in enumerate(features)]
    rows = panel.select(target, up, down, *values)
    found = []
    with passing(spark):
        known = [F.col(f"_v{k}").isNotNull().alias(f"_m{k}") for k in range(len(features))]
        masks = [f"_m{k}" for k in range(len(features))]
        ranked = with_mask_ranks(rows.filter(F.col(target).isNotNull()).select("*", *known), target, masks)
        ranked = ranked.select(*rows.columns, *[f"rank_{m}" for m in masks])
        unknown = rows.filter(F.col(target).isNull()).select("*", *[F.lit(None).cast("double").alias(f"rank_{m}") for m in masks])
        both = ranked.unionByName(unknown)
        for k, name in enumerate(features):
            with passing(spark):
                one = _signal_of(both.select(target, up, down, F.col(f"_v{k}").alias("v"), F.col(f"rank__m{k}").alias("_t")), name, target, [up, down])
                if one is not None:
                    found += one.collect()
    schema = (
        "feature string, valid_sample_count long, spearman_to_return_target double, unique_value_count long, abs_spearman_to_return_label double, "
        "abs_spearman_to_drawdown_label double, bottom_quantile_target_mean double, top_quantile_target_mean double"
    )
    out = spark.createDataFrame(found, schema)
    enough = (F.col("valid_sample_count") >= minimum) & (F.col("unique_value_count") >= 3)
    r = F.when(enough, F.col("spearman_to_return_target"))
    strength = F.greatest(F.abs(r), "abs_spearman_to_return_label", "abs_spearman_to_drawdown_label")
    return out.select(
        "feature", family(F.col("feature")).alias("family"), "valid_sample_count", "unique_value_count", F.abs(r).alias("abs_spearman_to_return_target"), r.alias("spearman_to_return_target"),
        "abs_spearman_to_return_label", "abs_spearman_to_drawdown_label", "top_quantile_target_mean", "bottom_quantile_target_mean",
        (F.col("top_quantile_target_mean") - F.col("bottom_quantile_target_mean")).alias("quantile_spread"),
        F.when(~enough, "insufficient").when(strength < 0.05, "near zero").when(strength >= 0.20, "strong").otherwise("modest").alias("signal_read"),
    )


def family_signal(signal: DataFrame, top: int = 15) -> DataFrame:
    """Per family: median and maximum strength, best feature, share of the top list."""
    s = F.round("abs_spearman_to_return_target", 12)
    w = Window.orderBy(s.desc_nulls_last(), "feature")  # one row per feature
    ranked = signal.withColumn("_in", (F.row_number().over(w) <= top).cast("int"))
    size = F.least(F.lit(top), F.sum(F.lit(1)).over(Window.partitionBy()))
    return ranked.withColumn("_size", size).groupBy("family").agg(
        F.count(F.lit(1)).alias("feature_count"), F.median(s).alias("median_abs_signal"), F.max(s).alias("max_abs_signal"),
        F.min(F.struct((-s).alias("s"), F.col("feature")))["feature"].alias("top_feature"), (F.sum("_in") / F.max("_size")).alias("share_of_top_features"),
    )


def signal_strength() -> Column:
    return F.greatest("abs_spearman_to_return_target", "abs_spearman_to_return_label", "abs_spearman_to_drawdown_label")


def top_signals(signal: DataFrame, n: int = 15) -> DataFrame:
    """The strongest features; ties by name, features without any relation last."""
    return signal.orderBy(F.round(signal_strength(), 12).desc_nulls_last(), "feature").limit(n)


def quantile_signals(signal: DataFrame, n: int = 10) -> DataFrame:
    """The features with the widest spread of the target between their outer quantiles."""
    spread = F.col("top_quantile_target_mean") - F.col("bottom_quantile_target_mean")
    rows = signal.select(
        "feature", "family", "valid_sample_count", "bottom_quantile_target_mean", "top_quantile_target_mean", spread.alias("quantile_spread"), F.abs(spread).alias("abs_quantile_spread")
    )
    return rows.filter("quantile_spread IS NOT NULL").orderBy(F.round("abs_quantile_spread", 12).desc(), "feature").limit(n)


# Limits of the signal warnings.
SIGNAL_SAMPLES, SIGNAL_VALUES, SIGNAL_NEAR_ZERO, COMPLEX_SHARE = 20, 3, 0.05, 0.50
COMPLEX_FAMILY = "Fourier / wavelet / complex transform"


def signal_warnings(signal: DataFrame, families: DataFrame, redundant_features: Sequence[str] = ()) -> DataFrame:
    """``warning, severity, feature_count, detail`` of the univariate signals; one row per feature comes in."""
    strength, place = signal_strength(), F.row_number().over(Window.orderBy(F.round(signal_strength(), 12).desc_nulls_last(), "feature"))
    rows = signal.withColumns({"_s": strength, "_place": place})

    def listed(where: Column, size: int = 8) -> Column:
        names = F.transform(F.sort_array(F.collect_list(F.when(where, F.struct("_place", "feature")))), lambda x: x["feature"])
        return F.array_join(F.slice(names, 1, size), ", ")

    few, flat = F.col("valid_sample_count") < SIGNAL_SAMPLES, F.col("unique_value_count") < SIGNAL_VALUES
    near, top = F.col("_s") < SIGNAL_NEAR_ZERO, (F.col("_place") <= 5) & F.col("feature").isin(*redundant_features)
    counts = {"few": few, "flat": flat, "near": near, "top": top}
    one = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count("_s").alias("known"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()],
        listed(few).alias("few_names"), listed(flat).alias("flat_names"), F.array_join(F.array_sort(F.collect_list(F.when(top, F.col("feature")))), ", ").alias("top_names"),
    )
    complex_share = families.filter((F.col("family") == COMPLEX_FAMILY) & (F.col("share_of_top_features") >= COMPLEX_SHARE)).agg(F.max("feature_count").alias("complex"))
    one = one.crossJoin(F.broadcast(complex_share))
    none = F.lit("")

    def row(when: Column, name: str, severity: str, count: Column, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("warning"), F.lit(severity).alias("severity"), count.cast("long").alias("feature_count"), detail.alias("detail")))

    found = F.array_compact(
        F.array(
            row(F.col("few") > 0, "too few valid samples", "warning", F.col("few"), F.col("few_names")),
            row(F.col("flat") > 0, "too few unique values", "warning", F.col("flat"), F.col("flat_names")),
            row(F.col("known") == 0, "target relation unavailable", "warning", F.col("n"), none),
            row((F.col("known") > 0) & (F.col("near") / F.col("known") >= 0.75), "near-zero univariate signal", "info", F.col("near"), F.lit(f"threshold={SIGNAL_NEAR_ZERO:.2f}")),
            row(F.col("complex").isNotNull(), "complex feature signal concentration", "info", F.col("complex"), F.lit(COMPLEX_FAMILY)),
            row(F.col("top") > 0, "top signal features are redundant", "info", F.col("top"), F.col("top_names")),
        )
    )
    empty = row(F.col("n") == 0, "feature signal unavailable", "warning", F.lit(0), F.lit("empty sample or no numeric features"))
    clean = row(F.size(found) == 0, "no material feature signal warnings", "info", F.lit(0), none)
    return one.select(F.inline(F.when(F.col("n") == 0, F.array(empty)).when(F.size(found) == 0, F.array(clean)).otherwise(found)))


# --- importance -------------------------------------------------------------


def prepared_importance(importance: DataFrame) -> DataFrame:
    """Fold-normalized importances, plus an ``all_selected_models`` copy where models differ."""
    keys = ["target", "model", "fold"]
    totals = importance.groupBy(*keys).agg(F.sum("abs_importance").alias("_t"))
    scaled = importance.join(totals, keys).withColumn(
        "abs_importance", F.when(F.col("_t") > 0, F.col("abs_importance") / F.col("_t")).otherwise(F.col("abs_importance"))
    ).drop("_t").withColumn("feature_family", family(F.col("feature")))
    several = importance.groupBy("target").agg(F.count_distinct("model").alias("_m")).filter("_m > 1").select("target")
    return scaled.unionByName(scaled.join(several, "target", "left_semi").withColumn("model", F.lit("all_selected_models")))


def _cv(mean: Column, std: Column) -> Column:
    return F.when(mean == 0, F.when(std == 0, 0.0)).otherwise(std / mean)


def _stability(folds: Column, top: Column, cv: Column, positive: Column | None = None) -> Column:
    c = F.coalesce(cv, F.lit(float("inf")))
    steady = (top / folds >= 0.6) & (c <= 1.0)
    if positive is not None:
        steady = steady & (positive / folds >= 0.6)
    return F.when(folds < 3, "insufficient_data").when(steady, "stable").when((top <= 1) | (c > 2.0), "unstable").otherwise("mixed")


def importance_stability(prepared: DataFrame) -> DataFrame:
    """``prepared`` groups hold one row per feature, so the fold percentile is small."""
    keys = ["target", "model", "fold"]
    cut = prepared.filter("abs_importance > 0").groupBy(*keys).agg(F.expr("percentile(abs_importance, 0.9)").alias("_cut"))
    rows = prepared.join(cut, keys, "left").withColumn(
        "top", F.coalesce((F.col("abs_importance") >= F.col("_cut")) & (F.col("abs_importance") > 0), F.lit(False))
    )
    out = rows.groupBy("target", "model", "feature", "feature_family").agg(
        F.count_distinct("fold").alias("fold_count"), F.avg("abs_importance").alias("mean_importance"), F.stddev_pop("abs_importance").alias("std_importance"),
        F.count_distinct(F.when(F.col("abs_importance") > 0, F.col("fold"))).alias("positive_fold_count"), F.count_distinct(F.when(F.col("top"), F.col("fold"))).alias("top_decile_fold_count"),
    ).withColumn("importance_cv", _cv(F.col("mean_importance"), F.col("std_importance")))
    return out.withColumn("classification", _stability(F.col("fold_count"), F.col("top_decile_fold_count"), F.col("importance_cv"), F.col("positive_fold_count")))


def family_importance(prepared: DataFrame) -> DataFrame:
    keys = ["target", "model", "fold"]
    per = prepared.groupBy(*keys, "feature_family").agg(
        F.round(F.sum("abs_importance"), 12).alias("v"), F.count_distinct("feature").alias("k")
    )
    best = per.filter("v > 0").groupBy(*keys).agg(F.max("v").alias("_best"))
    rows = per.join(best, keys, "left").withColumn("top", F.coalesce(F.col("v") == F.col("_best"), F.lit(False)))
    out = rows.groupBy("target", "model", "feature_family").agg(
        F.max("k").alias("feature_count"), F.count_distinct("fold").alias("fold_count"), F.avg("v").alias("mean_family_importance"),
        F.stddev_pop("v").alias("std_family_importance"), F.count_distinct(F.when(F.col("top"), F.col("fold"))).alias("top_family_fold_count"),
    )
    return out.withColumn(
        "classification",
        _stability(F.col("fold_count"), F.col("top_family_fold_count"), _cv(F.col("mean_family_importance"), F.col("std_family_importance"))),
    )


def importance_readiness(stability: DataFrame) -> DataFrame:
    c = F.col("classification")
    steady = F.sort_array(F.collect_list(F.when(c == "stable", F.struct((-F.col("mean_importance")).alias("m"), "feature"))))
    out = stability.groupBy("target", "model").agg(
        F.count_if(c == "stable").alias("stable_feature_count"), F.count_if(c == "mixed").alias("mixed_feature_count"), F.count_if(c == "unstable").alias("unstable_feature_count"),
        F.array_join(F.transform(F.slice(steady, 1, 5), lambda s: s["feature"]), ", ").alias("top_stable_features"), F.count_if(c != "insufficient_data").alias("_usable"),
    )
    s = F.col("stable_feature_count")
    return out.withColumn(
        "classification",
        F.when(F.col("_usable") == 0, "insufficient_data").when((s >= 3) & (F.col("unstable_feature_count") <= s), "promising").when(s > 0, "watch").otherwise("not_ready"),
    ).drop("_usable")


def group_importance(importance: DataFrame) -> DataFrame:
    kind = F.when(F.col("feature").startswith("fourier_"), "Fourier").when(F.col("feature").startswith("wavelet_"), "Wavelet").otherwise("Technical")
    return importance.groupBy(kind.alias("feature_group")).agg(F.sum("abs_importance").alias("abs_importance"))


# --- validation -------------------------------------------------------------


def leakage(folds: DataFrame, horizon: int, embargo: int | None = None) -> DataFrame:
    gap = F.min(F.datediff("test_start", "train_end"))
    out = folds.agg(F.count_distinct("fold").alias("fold_count"), gap.alias("min_train_test_gap_days"))
    short = (F.col("min_train_test_gap_days") < horizon) | F.lit(embargo is not None and embargo < horizon)
    thin = F.col("min_train_test_gap_days") < horizon * 1.5
    none = F.col("fold_count") < 1
    return out.select(
        F.lit("train_test_gap").alias("diagnostic"), F.lit(horizon).alias("label_horizon_days"), "fold_count", "min_train_test_gap_days", F.lit(horizon).alias("required_embargo_days"),
        F.when(none, "insufficient").when(short, "high").when(thin, "thin").otherwise("low").alias("overlap_risk"),
        F.when(none, "insufficient_data").when(short, "risky").when(thin, "watch").otherwise("clean").alias("classification"),
    )


def fold_stability(fold_metrics: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    def std(c: str) -> Column:
        return F.when(F.count(c) > 1, F.stddev_pop(c))

    out = fold_metrics.groupBy(*by).agg(
        F.count_distinct("fold").alias("fold_count"), F.avg("roc_auc").alias("mean_roc_auc"), std("roc_auc").alias("std_roc_auc"), F.avg("pr_auc").alias("mean_pr_auc"), std("pr_auc").alias("std_pr_auc"),
        F.avg("brier_score").alias("mean_brier"), std("brier_score").alias("std_brier"), F.max("roc_auc").alias("best_fold_metric"), F.min("roc_auc").alias("worst_fold_metric"),
    ).withColumn("fold_instability", F.col("best_fold_metric") - F.col("worst_fold_metric"))

    def over(a: float, g: float, b: float) -> Column:
        tests = [F.col("std_roc_auc") > a, F.col("fold_instability") > g, F.col("std_brier") > b]
        return F.coalesce(tests[0], F.lit(False)) | F.coalesce(tests[1], F.lit(False)) | F.coalesce(tests[2], F.lit(False))

    return out.withColumn(
        "classification", F.when(F.col("fold_count") < 3, "insufficient_data").when(over(0.08, 0.15, 0.04), "unstable").when(over(0.04, 0.08, 0.02), "mixed").otherwise("stable")
    )


def overfit_warnings(predictions: DataFrame, samples: int = 100, tickers: int = 3, minimum: int = 5) -> DataFrame:
    """Coverage, concentration and spread support; settled ``predictions`` with regime, probability, actual."""
    one = predictions.agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_distinct("ticker").alias("ticker_count"), F.count_distinct("regime").alias("regime_count"), F.avg("actual").alias("positive_rate"),
    )
    cut = quantile_bucketed(predictions.dropna(subset=["probability", "forward_excess_return"]), [], "probability", 3, "_b")
    per = cut.groupBy("_b").agg(F.avg("forward_excess_return").alias("m"), F.count(F.lit(1)).alias("n"))
    enough = (F.count(F.lit(1)) >= 2) & (F.min_by("n", "_b") >= minimum) & (F.max_by("n", "_b") >= minimum)
    spread = per.agg(F.when(enough, F.max_by("m", "_b") - F.min_by("m", "_b")).alias("bucket_spread"))
    shares = concentration(predictions, "ticker").select(F.col("share").alias("_ts")).crossJoin(F.broadcast(concentration(predictions, "regime").select(F.col("share").alias("_rs"))))
    wide = one.crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(shares))
    few, s = F.col("ticker_count") < tickers, F.col("bucket_spread")
    reads = [
        ("sample_coverage", F.when((F.col("sample_count") < samples) | few, "insufficient_data").otherwise("low_risk")),
        ("ticker_concentration", F.when(F.col("_ts") > 0.50, "likely_overfit").when(few, "insufficient_data").otherwise("low_risk")),
        ("regime_concentration", F.when(F.col("_rs") > 0.70, "watch").when(F.col("regime_count") < 2, "insufficient_data").otherwise("low_risk")),
        ("bucket_spread_support", F.when(s.isNull(), "unavailable").when(F.abs(s) <= 0.0025, "watch").when(s < -0.0025, "likely_overfit").otherwise("low_risk")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("diagnostic"), c.alias("classification")) for n, c in reads])
    return wide.select("sample_count", "ticker_count", "regime_count", "positive_rate", "bucket_spread", F.inline(rows))
