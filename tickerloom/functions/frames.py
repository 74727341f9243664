"""Row frames over one entity's calendar.

A ``(ticker, date)`` key is unique after normalization, so a ticker window never
holds more rows than the calendar has dates, however large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.stats import over
from tickerloom.functions.trailing import with_trailing


def entity():
    return Window.partitionBy("ticker").orderBy("date")


def entity_all():
    return Window.partitionBy("ticker")


def to_now():
    return entity().rowsBetween(Window.unboundedPreceding, 0)


def c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def trailing(rows: int):
    return entity().rowsBetween(-(rows - 1), 0)


def leading(rows: int):
    return entity().rowsBetween(1, rows)


def rolled(aggregate: Column, counted: Column, rows: int, minimum: int | None = None) -> Column:
    """A trailing aggregate that is NULL until ``minimum`` non-null rows exist."""
    frame = trailing(rows)
    return F.when(F.count(counted).over(frame) >= (minimum or rows), aggregate.over(frame))


def running_totals(x: str, squares: bool = False) -> dict[str, Column]:
    """Running totals from which any trailing mean or deviation is two lags away.

    A sliding frame re-adds all of its rows for every output row; the totals cost
    one step per row whatever the window.
    """
    known = F.coalesce(F.col(x), F.lit(0.0))
    totals = {f"_sum_{x}": F.sum(known).over(to_now()), f"_known_{x}": F.count(x).over(to_now())}
    if squares:
        totals[f"_squares_{x}"] = F.sum(known * known).over(to_now())
    return totals


def since(total: str, rows: int) -> Column:
    """Part of a running total that belongs to the last ``rows`` rows."""
    return F.col(total) - F.coalesce(F.lag(total, rows).over(entity()), F.lit(0))


def running_mean(x: str, rows: int) -> Column:
    n = since(f"_known_{x}", rows)
    return F.when(n >= rows, since(f"_sum_{x}", rows) / n)


def running_std(x: str, rows: int) -> Column:
    """Sample deviation over a full window."""
    n, total = since(f"_known_{x}", rows), since(f"_sum_{x}", rows)
    variance = (since(f"_squares_{x}", rows) - total * total / n) / (n - 1)
    return F.when(n >= rows, F.sqrt(F.greatest(variance, F.lit(0.0))))


def rolled_median(x: str, rows: int, minimum: int) -> Column:
    """Trailing median from the sorted frame, as a column; ``with_rolled_median`` is cheaper for long frames."""
    values = F.sort_array(F.collect_list(x).over(trailing(rows)))
    known = F.count(x).over(trailing(rows)).cast("int")
    lower = F.element_at(values, F.greatest(((known + 1) / 2).cast("int"), F.lit(1)))
    upper = F.element_at(values, F.greatest((known / 2).cast("int") + 1, F.lit(1)))
    return F.when(known >= minimum, (lower + upper) / 2)


def with_rolled_median(df: DataFrame, x: str, rows: int, minimum: int, output: str) -> DataFrame:
    """Add the trailing median; NULL until ``minimum`` non-null rows exist.

    A sliding frame would collect and sort its rows again for every output row.
    """
    return with_trailing(df, (), [(output, x, rows, minimum)])


def change(x: Column | str, rows: int = 1) -> Column:
    """Return over ``rows`` rows of the entity's own calendar."""
    return over(c(x), F.lag(c(x), rows).over(entity())) - 1


def carried(x: Column | str) -> Column:
    """Last known value up to and including the row."""
    return F.last(c(x), ignorenulls=True).over(to_now())


def compounded(x: Column, window) -> Column:
    return F.product(1 + x).over(window)


def run_length(condition: Column, reset_count: Column) -> Column:
    """Rows since ``condition`` last failed; ``reset_count`` counts failures so far."""
    island = Window.partitionBy("ticker", reset_count).orderBy("date")
    return F.when(condition, F.sum(condition.cast("long")).over(island)).otherwise(F.lit(0))
