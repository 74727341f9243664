"""Classification, calibration and rank metrics over any grouping.

Probabilities are first collapsed to one row per distinct value and group, with
map-side combine, so a value shared by most rows costs one row.  Curves then run
over ordered values with the sliced running totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.buckets import edge_bucket
from tickerloom.plans import curves
from tickerloom.plans.ranking import (
    attach_groups,
    quantile_points,
    with_positions,
    with_running_totals,
)

DATE_TIES = ["date", "ticker"]


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def _curve(known: DataFrame, by: list[str], label: str, probability: str, calendar_bound: bool) -> DataFrame:
    """Positive and all rows (``_tp``, ``_n``) of every group and probability ``_p``, and those of smaller ones."""
    values = known.groupBy(*by, F.col(probability).alias("_p")).agg(F.sum(label).alias("_tp"), F.count(F.lit(1)).alias("_n"))
    return with_running_totals(values, by, "_p", ["_tp", "_n"], calendar_bound)


def _shared_curve(known: DataFrame, by: list[str], label: str, probability: str, calendar_bound: bool, shared: str) -> DataFrame:
    """``_curve``, with the few values of ``shared`` side by side while the probabilities are ordered."""
    names = sorted(r[0] for r in known.select(shared).distinct().collect())
    rest = [b for b in by if b != shared]
    columns = [c for i in range(len(names)) for c in (f"_tp{i}", f"_n{i}")]
    sums = []
    for i, name in enumerate(names):
        own = F.col(shared) == name
        sums += [F.coalesce(F.sum(F.when(own, F.col(label))), F.lit(0)).alias(f"_tp{i}"), F.count_if(own).alias(f"_n{i}")]
    wide = with_running_totals(known.groupBy(*rest, F.col(probability).alias("_p")).agg(*sums), rest, "_p", columns, calendar_bound)
    entries = [
        F.struct(F.lit(name).alias(shared), *(F.col(f"{c}{i}").alias(c) for c in ("_tp", "_n", "below__tp", "below__n"))) for i, name in enumerate(names)
    ]
    return wide.select(*rest, "_p", F.inline(F.array(*entries))).filter("_n > 0")


def binary_metrics(
    df: DataFrame, by: Sequence[str], label: str, probability: str, threshold: float = 0.5, calendar_bound: bool = False, shared: str | None = None
) -> DataFrame:
    """Counts, rates, Brier, ROC-AUC and average precision per group.

    ``calendar_bound`` when a group has at most a row per date (ticker, fold and ticker).
    ``shared`` names a key with few values, none null, whose rows have their probabilities in common: they are ordered once for all.
    """
    by = list(by)
    known = df.filter(F.col(label).isNotNull() & F.col(probability).isNotNull())
    if shared and not known.isEmpty():
        curve = _shared_curve(known, by, label, probability, calendar_bound, shared)
    else:
        curve = _curve(known, by, label, probability, calendar_bound)
    if calendar_bound:  # the window of the running totals has them
        whole = Window.partitionBy(*by)
        joined = curve.dropna(subset=by).withColumns({"_all_pos": F.sum("_tp").over(whole), "_all_n": F.sum("_n").over(whole)})
    else:
        totals = curve.groupBy(*by).agg(F.sum("_tp").alias("_all_pos"), F.sum("_n").alias("_all_n"))  # from the stored order
        joined = attach_groups(curve, totals, by)
    tp, n, p = F.col("_tp"), F.col("_n"), F.col("_p")
    pos, total = F.col("_all_pos"), F.col("_all_n")
    neg_below = F.col("below__n") - F.col("below__tp")
    called = p >= threshold
    out = joined.groupBy(*by).agg(
        F.max(total).alias("sample_count"),
        F.max(pos).alias("positive_count"),
        (F.max(pos) / F.max(total)).alias("positive_rate"),
        (F.sum(n * p) / F.max(total)).alias("mean_probability"),
        (F.sum(n * p * p - 2 * p * tp + tp) / F.max(total)).alias("brier_score"),
        F.sum(F.when(called, tp).otherwise(0.0)).alias("_hit"),
        F.sum(F.when(called, n).otherwise(0)).alias("_called"),
        F.sum(tp * (neg_below + (n - tp) / 2)).alias("_area"),
        F.sum(tp / F.nullif(pos, F.lit(0.0)) * (pos - F.col("below__tp")) / (total - F.col("below__n"))).alias("_ap"),
    )
    pos, neg = F.col("positive_count"), F.col("sample_count") - F.col("positive_count")
    both = (pos > 0) & (neg > 0)
    hit, called = F.col("_hit"), F.col("_called")
    precision, recall = F.coalesce(ratio(hit, called), F.lit(0.0)), F.coalesce(ratio(hit, pos), F.lit(0.0))
    return out.select(
        *by,
        "sample_count",
        "positive_count",
        "positive_rate",
        "mean_probability",
        (F.col("positive_rate") - F.col("mean_probability")).alias("calibration_gap"),
        "brier_score",
        ((hit + neg - (called - hit)) / F.col("sample_count")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
        F.when(both, F.col("_area") / F.nullif(pos * neg, F.lit(0.0))).alias("roc_auc"),
        F.when(both, F.col("_ap")).alias("pr_auc"),
    )


def segment_metrics(
    df: DataFrame, by: Sequence[str], labels: dict[str, tuple[Column, Column]], probability: str, scopes: Sequence[Sequence[str]], named: str | None = None,
    ties: Sequence[str] = (), threshold: float = 0.5,
) -> list[DataFrame]:
    """``binary_metrics`` of every scope (a list of key columns that includes ``by``) from one ordering by (``by``, probability).

    ``labels`` maps a name, shown in the column ``named``, to the rows that a row stands for and how many are positive; the
    labels share the probability.  With ``ties`` also the sizes and positives of the outer rank thirds: ``bottom_n``,
    ``bottom_total``, ``top_n``, ``top_total``.  Groups with an unknown key are left out.
    """
    order, keys = curves.ordered(df, by, probability, list(labels.values()), scopes, ties)
    sums = curves.segment_sums(order, threshold, bool(ties))
    counted = ["sample_count long", "bottom_n long", "top_n long"]
    rates = [f"{c} double" for c in ("positive_count positive_rate mean_probability calibration_gap brier_score accuracy precision recall f1 roc_auc pr_auc bottom_total top_total").split()]
    out = []
    for scope, groups, found in zip(scopes, keys, sums):
        rows = []
        for key, entry in zip(groups, found):
            for name, values in zip(labels, entry):
                if values[0] and None not in key:
                    rows.append((*key, *([name] if named else []), *_read(*map(float, values))))
        types = [f"{c} {df.schema[c].dataType.simpleString()}" for c in scope] + ([f"{named} string"] if named else [])
        table = df.sparkSession.createDataFrame(rows, ", ".join([*types, *counted, *rates]))
        out.append(table if ties else table.drop("bottom_n", "top_n", "bottom_total", "top_total"))
    return out


def _read(n, pos, p, pp, hit_p, called, hit, area, ap, bottom, top) -> tuple:
    """Counts and metrics of a group from the sums of ``curves``."""
    neg = n - pos
    low, high = (n - 1) // 3 + 1, 2 * (n - 1) // 3 + 1
    precision, recall = hit / called if called else 0.0, hit / pos if pos else 0.0
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    both = pos > 0 and neg > 0
    return (
        int(n), int(low), int(n - high), pos, pos / n, p / n, pos / n - p / n, (pp - 2 * hit_p + pos) / n, (hit + neg - (called - hit)) / n, precision, recall, f1,
        area / (pos * neg) if both else None, ap if both else None, bottom, top if n > high else None,
    )


def confusion(df: DataFrame, label: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """2 x 2 counts, zero cells kept."""
    known = df.filter(F.col(label).isNotNull())
    called = F.coalesce(F.col(probability) >= threshold, F.lit(False))
    one = known.agg(
        *[
            F.count_if((F.col(label) == a) & (called == bool(p))).alias(f"n{a}{p}")
            for a in (0, 1)
            for p in (0, 1)
        ]
    )
    rows = [
        F.struct(F.lit(f"Actual {a}").alias("actual"), F.col(f"n{a}0").alias("predicted_0"), F.col(f"n{a}1").alias("predicted_1"))
        for a in (0, 1)
    ]
    return one.select(F.inline(F.array(*rows)))


def calibration(df: DataFrame, label: str, probability: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Right-closed probability bins on [0, 1]; 0 falls into the first."""
    p = F.col(probability)
    edges = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    known = df.filter(F.col(label).isNotNull() & p.between(0, 1))
    index = F.when(p <= 1.0 / bins, 0).otherwise(F.ceil(p * bins).cast("int") - 1)
    # ceil can land one bin high or low on an edge; the edge list decides.
    index = F.when(F.get(edges, index) >= p, index - 1).when(F.get(edges, index + 1) < p, index + 1).otherwise(index)
    return (
        known.withColumn("bin", F.greatest(index, F.lit(0)))
        .groupBy(*by, "bin")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg(probability).alias("average_probability"),
            F.avg(label).alias("observed_rate"),
        )
        .withColumn("calibration_gap", F.col("observed_rate") - F.col("average_probability"))
    )


def calibration_summary(df: DataFrame, label: str, probability: str, by: Sequence[str] = ()) -> DataFrame:
    known = df.filter(F.col(label).isNotNull() & F.col(probability).isNotNull())
    error = F.col(probability) - F.col(label)
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.avg(probability).alias("average_predicted_probability"),
        F.avg(label).alias("observed_positive_rate"),
        (F.avg(label) - F.avg(probability)).alias("calibration_gap"),
        F.avg(error * error).alias("brier_score"),
    )


def quantile_bucketed(df: DataFrame, by: Sequence[str], value: str, buckets: int, output: str) -> DataFrame:
    """Right-closed quantile buckets of the value (duplicate edges dropped)."""
    by = list(by)
    known = df.filter(F.col(value).isNotNull())
    ranked = with_positions(known.select(*by, value, *DATE_TIES), by, value, DATE_TIES)
    edges = quantile_points(ranked, by, value, [i / buckets for i in range(buckets + 1)])
    return attach_groups(known, edges, by).withColumn(output, edge_bucket(F.col(value), F.col("edges"))).drop("edges")


def quintiles(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Outcomes by score quintile, for each ``by``; ``df`` must be settled."""
    needed = [score, label, "forward_return", "forward_excess_return", "forward_drawdown"]
    out = quantile_bucketed(df.dropna(subset=needed), list(by), score, 5, "_b")
    return out.groupBy(*by, F.concat(F.lit("Q"), (F.col("_b") + 1).cast("string")).alias("score_quintile")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(score).alias("average_score"),
        F.avg(label).alias("hit_rate"),
        F.avg("forward_return").alias("average_forward_return"),
        F.avg("forward_excess_return").alias("average_forward_excess_return"),
        F.avg("forward_drawdown").alias("average_forward_drawdown"),
    )


def worst_group(df: DataFrame, by: Sequence[str], group: str, label: str, probability: str, output: str, minimum: int = 1) -> DataFrame:
    """Group value with the largest Brier score and that score; ties go to the smaller name."""
    error = F.col(probability) - F.col(label)
    scored = df.groupBy(*by, group).agg(F.round(F.avg(error * error), 12).alias("_b"), F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_b")).alias("b"), F.col(group).alias("g")))
    return scored.filter(F.col("_n") >= minimum).groupBy(*by).agg(best.alias("_w")).select(
        *by, F.col("_w.g").alias(output), (-F.col("_w.b")).alias(f"{output}_brier")
    )


def concentration(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of the most frequent non-blank value."""
    counted = df.filter(F.trim(F.col(column).cast("string")) != "").groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*by).agg(
        (F.max("_n") / F.sum("_n")).alias("share"),
        F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v")))["v"].alias("most_frequent"),
    )
