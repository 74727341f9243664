"""Walk-forward folds over the distinct dates of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(panel: DataFrame) -> DataFrame:
    """Distinct dates with their 0-based index; the window holds dates only."""
    return (
        panel.select("date")
        .distinct()
        .withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)
    )


def walk_forward(
    panel: DataFrame, train: int = 252, test: int = 63, step: int | None = None, embargo: int = 20,
    open_end: bool = False,
) -> DataFrame:
    """Fold bounds as dates; only complete folds unless ``open_end``."""
    step = step or test
    days = calendar(panel)
    span = days.agg(F.max("idx").alias("last"))
    longest = (
        F.floor((F.col("last") - train - embargo - (0 if open_end else test - 1)) / step)
    )
    first = F.col("k") * step
    bounds = {
        "train_start": first,
        "train_end": first + train - 1,
        "test_start": first + train + embargo,
        "test_end": F.least(first + train + embargo + test - 1, F.col("last")),
    }
    named = [
        F.struct(F.lit(n).alias("bound"), v.cast("int").alias("idx")) for n, v in bounds.items()
    ]
    return (
        span.filter(longest >= 0)
        .select("last", F.explode(F.sequence(F.lit(0), longest.cast("int"))).alias("k"))
        .select((F.col("k") + 1).cast("long").alias("fold"), F.explode(F.array(*named)).alias("b"))
        .select("fold", "b.bound", "b.idx")
        .join(days, "idx")
        .groupBy("fold")
        .agg(*[F.max(F.when(F.col("bound") == n, F.col("date"))).alias(n) for n in bounds])
    )


def assign(panel: DataFrame, folds: DataFrame, part: str, days: DataFrame | None = None) -> DataFrame:
    """Add ``fold`` to rows whose date lies in the ``train`` or ``test`` interval.

    Folds are expanded to (date, fold) pairs first, so the panel side is an
    equi-join on ``date`` with a calendar-sized table, not a range join.
    """
    dates = (days if days is not None else panel).select("date").distinct()
    pairs = dates.join(
        F.broadcast(folds), F.col("date").between(F.col(f"{part}_start"), F.col(f"{part}_end"))
    ).select("fold", "date")
    return panel.join(F.broadcast(pairs), "date")
