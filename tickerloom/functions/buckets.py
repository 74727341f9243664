"""Bucketing rules shared by the diagnostic tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 0.0025


def rank_bucket(position: Column, size: Column, buckets: int) -> Column:
    """0-based equal-count bucket of a 1-based position among ``size`` rows."""
    raw = F.ceil((position - 1) * F.lit(buckets) / F.nullif(size - 1, F.lit(0))) - 1
    return F.greatest(F.coalesce(raw, F.lit(0)), F.lit(0)).cast("int")


def edge_bucket(value: Column, edges: Column) -> Column:
    """0-based right-closed bucket between distinct sorted edges, lowest included."""
    distinct = F.array_distinct(edges)
    inner = F.slice(distinct, 2, F.greatest(F.size(distinct) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e < value))


def score_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when(score <= 40, "Low")
        .when(score <= 70, "Medium")
        .otherwise("High")
    )


def third(probability: Column) -> Column:
    return (
        F.when(probability.isNull(), F.lit(None).cast("string"))
        .when(probability <= 1 / 3, "low")
        .when(probability <= 2 / 3, "mid")
        .otherwise("high")
    )


def shape(means: list[Column], tolerance: float = TOLERANCE) -> Column:
    """aligned / inverted / flat / mixed for ordered bucket means, NULL means skipped.

    Fewer than two known means read ``insufficient``.
    """
    known = F.array_compact(F.array(*means))
    steps = F.zip_with(
        F.slice(known, 2, F.greatest(F.size(known) - 1, F.lit(0))),
        F.slice(known, 1, F.greatest(F.size(known) - 1, F.lit(0))),
        lambda hi, lo: hi - lo,
    )
    t = F.lit(tolerance)
    return (
        F.when(F.size(known) < 2, "insufficient")
        .when(F.forall(steps, lambda d: d > t), "aligned")
        .when(F.forall(steps, lambda d: d < -t), "inverted")
        .when(F.forall(steps, lambda d: F.abs(d) <= t), "flat")
        .otherwise("mixed")
    )


def spread_direction(spread: Column, sample: Column, minimum: int = 20) -> Column:
    return (
        F.when((sample < minimum) | spread.isNull(), "insufficient")
        .when(spread > TOLERANCE, "aligned")
        .when(spread < -TOLERANCE, "inverted")
        .otherwise("flat")
    )
