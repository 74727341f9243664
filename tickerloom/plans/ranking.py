"""Exact ordering of groups of any size.

``row_number() over (partition by date order by x)`` puts a whole date in one
task, and an un-partitioned window puts the whole table there.  Here one path
serves every size:

1. rows are range-partitioned and sorted by (group, value, ties).  With ties that
   make rows distinct, neither a large group, nor a value that a third of the rows
   share, nor a common name prefix can fill a partition;
2. the sorted partitions are settled with each row's place, so every later pass
   sees the same order;
3. counts per (group, partition), a table of at most groups + partitions rows,
   give each partition's offset inside a group.

Joins go by (group, partition), so the rows of a large group meet in as many tasks
as they have partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.plans.storage import settle, stored

BEFORE = (Window.unboundedPreceding, -1)
#: A one-row-per-group table is broadcast up to this many rows.
BROADCAST_ROWS = 100_000
#: Bins in which values between 0 and 1 are counted to find the edges of thirds.
BINS = 1024
_ROW_BITS = 33  # of monotonically_increasing_id


def attach_groups(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join a one-row-per-group table; with no keys, attach its only row.

    The table is broadcast if it is counted to be small, so that few-key joins
    don't put a large group into one task; else Spark shuffles both sides.
    """
    if not by:
        return df.crossJoin(F.broadcast(small))
    small = settle(small)
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, list(by), "inner")


def _as_names(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` sorted over all partitions, with ``_part`` and ``_row``, the place inside the partition."""
    at = F.col("_at")
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return stored(out).withColumns({"_part": F.shiftright(at, _ROW_BITS).cast("int"), "_row": at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}).drop("_at")


def _joined(df: DataFrame, small: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of a one-row-per-key table; NULL is a key like any other."""
    other = small.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *columns)
    on: Column = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(other, on, "inner").drop(*[f"_k{i}" for i in range(len(keys))])


def _offsets(placed: DataFrame, by: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """Per group and partition: ``_base`` (add ``_row`` for the 1-based position), ``group_size`` and
    the totals of earlier partitions."""
    parts = placed.groupBy(*by, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in totals])
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_part").rowsBetween(*BEFORE)
    return parts.select(
        *by,
        "_part",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_base"),
        F.sum("_n").over(whole).alias("group_size"),
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in totals],
    )


def with_positions(df: DataFrame, by, value: str, ties: Sequence[str], ranks: bool = False) -> DataFrame:
    """Add exact ``pos`` (1-based row number) and ``group_size``, with ``ranks`` also ``avg_rank`` and ``min_rank``.

    Order is ``value`` ascending, then ``ties``, which should tell rows apart.
    Rows with a NULL value must be filtered out first.
    """
    by = _as_names(by)
    placed = _placed(df, [*by, value, *ties])
    keys = [*by, "_part"]
    out = _joined(placed, _offsets(placed, by, []), keys, ["_base", "group_size"])
    out = out.withColumn("pos", (F.col("_base") + F.col("_row")).cast("long")).drop("_base", "_row")
    if ranks:  # runs of one value, first inside a partition and then over those that it spans
        runs = out.groupBy(*by, value, "_part").agg(F.min("pos").alias("_low"), F.count(F.lit(1)).alias("_same"))
        run = Window.partitionBy(*by, value)
        low, same = F.min("_low").over(run), F.sum("_same").over(run)
        runs = runs.select(*by, value, "_part", low.cast("long").alias("min_rank"), (low + (same - 1) / 2.0).alias("avg_rank"))
        out = _joined(out, runs, [*by, value, "_part"], ["min_rank", "avg_rank"])
    return out.drop("_part")


def with_running_totals(df: DataFrame, by, value: str, columns: Sequence[str], calendar_bound: bool = False) -> DataFrame:
    """Add ``below_<c>``: total of ``c`` over rows of the group with a smaller value.

    ``df`` holds one row per ``(by, value)``.  ``calendar_bound`` is for groups that
    hold at most a row per date and runs as one window per group.
    """
    by = _as_names(by)
    if calendar_bound:
        w = Window.partitionBy(*by).orderBy(value).rowsBetween(*BEFORE)
        return df.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"below_{c}") for c in columns])
    placed = _placed(df, [*by, value])
    keys = [*by, "_part"]
    inside = Window.partitionBy(*keys).orderBy("_row").rowsBetween(*BEFORE)
    local = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{c}") for c in columns])
    out = _joined(local, _offsets(placed, by, columns), keys, [f"_o_{c}" for c in columns])
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"below_{c}") for c in columns])


def quantile_points(positioned: DataFrame, by, value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles, read off an already numbered table."""
    by = _as_names(by)
    aggregates = []
    for i, q in enumerate(probabilities):
        h = (F.col("group_size") - 1) * F.lit(float(q))
        lo = F.floor(h) + 1
        hi = F.least(lo + 1, F.col("group_size"))
        aggregates += [
            F.max(F.when(F.col("pos") == lo, F.col(value))).alias(f"_lo{i}"),
            F.max(F.when(F.col("pos") == hi, F.col(value))).alias(f"_hi{i}"),
            F.max(h - F.floor(h)).alias(f"_f{i}"),
        ]
    points = [
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}"))
        for i in range(len(probabilities))
    ]
    return positioned.groupBy(*by).agg(*aggregates).select(*by, F.array(*points).alias("edges"))


def end_thirds(df: DataFrame, by, value: str, ties: Sequence[str], total: str) -> DataFrame:
    """Per group number and sum of ``total`` of the bottom and the top third by rank: ``bottom_n``, ``bottom_total``, ``top_n``, ``top_total``.

    Thirds as by ``rank_bucket`` of ``with_positions``.  Values, which lie in [0, 1], are counted in ``BINS``
    bins; only rows of the bins that a third's edge cuts, two of a group at most, are ordered.
    """
    by = _as_names(by)
    binned = df.select(*by, value, *ties, total, F.floor(F.col(value) * BINS).alias("_bin"))
    counts = binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.sum(total).alias("_sum"))
    whole = Window.partitionBy(*by)
    size, upto = F.sum("_n").over(whole), F.sum("_n").over(whole.orderBy("_bin"))
    last_bottom, last_middle = F.floor((size - 1) / 3) + 1, F.floor(2 * (size - 1) / 3) + 1
    bins = counts.select("*", (upto - F.col("_n")).alias("_below"), last_bottom.alias("_low"), last_middle.alias("_high"))
    bins = settle(bins)
    n, below, low, high = (F.col(c) for c in ("_n", "_below", "_low", "_high"))
    bottom, middle, top = below + n <= low, (below >= low) & (below + n <= high), below >= high
    cut = bins.filter(~(bottom | middle | top))
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_ROWS else cut
    mixed = with_positions(_joined(binned, cut, [*by, "_bin"], ["_below", "_low", "_high"]), [*by, "_bin"], value, ties)
    parts = [
        bins.filter(bottom | top).select(*by, bottom.alias("_is_bottom"), "_n", "_sum"),
        mixed.withColumn("_at", below + F.col("pos")).filter((F.col("_at") <= low) | (F.col("_at") > high)).select(
            *by, (F.col("_at") <= low).alias("_is_bottom"), F.lit(1).cast("long").alias("_n"), F.col(total).alias("_sum")
        ),
    ]
    is_bottom = F.col("_is_bottom")
    ends = parts[0].unionByName(parts[1]).groupBy(*by)
    return ends.agg(
        F.sum(F.when(is_bottom, n).otherwise(0)).alias("bottom_n"), F.sum(F.when(is_bottom, F.col("_sum"))).alias("bottom_total"),
        F.sum(F.when(~is_bottom, n).otherwise(0)).alias("top_n"), F.sum(F.when(~is_bottom, F.col("_sum"))).alias("top_total"),
    )


def runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of one value in sorted numbers; NaN equals NaN."""
    same = (values[1:] == values[:-1]) | (np.isnan(values[1:]) & np.isnan(values[:-1]))
    return np.concatenate([[0], np.flatnonzero(~same) + 1])


def _locally_ranked(batches: Iterator[pa.RecordBatch], masks: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a task (value first) with ``_edge`` (1 first run, 2 last run, else 0) and, for each mask, the average
    rank among the task's rows of the mask and their number in the run; ranks of edge runs are 0."""

    def ranked(table: pa.Table, first: bool, last: bool, before: np.ndarray) -> pa.RecordBatch:
        """Whole runs; ``before`` counts the rows of earlier ones and goes on."""
        value = table.column(0).to_numpy()
        starts = runs(value)
        sizes = np.diff([*starts, len(value)])
        edge = np.zeros(len(starts), np.int8)
        if last:
            edge[-1] = 2
        if first:
            edge[0] = 1
        columns = []
        for k, m in enumerate(masks):
            same = np.add.reduceat(table.column(m).to_numpy().astype(np.int64), starts)
            upto = before[k] + np.cumsum(same)
            columns += [pa.array(np.repeat(np.where(edge > 0, 0.0, upto - (same - 1) / 2.0), sizes)), pa.array(np.repeat(same, sizes))]
            before[k] = upto[-1]
        batch = table.combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.repeat(edge, sizes)), *columns], [*batch.schema.names, "_edge", *(f"_{x}{k}" for k in range(len(masks)) for x in "as")])

    before, first, waiting = np.zeros(len(masks), np.int64), True, []  # ``waiting`` holds the open run
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(0).to_numpy()
        if waiting:
            value = np.concatenate([waiting[-1].column(0).to_numpy()[-1:], value])
        start = runs(value)[-1] - bool(waiting)  # of the last run, in the batch
        if start > 0 or (start == 0 and waiting):
            yield ranked(pa.Table.from_batches([*waiting, batch.slice(0, start)]), first, False, before)
            first, waiting = False, []
        waiting.append(batch.slice(max(start, 0)))
    if waiting:
        yield ranked(pa.Table.from_batches(waiting), first, True, before)


def with_mask_ranks(df: DataFrame, value: str, masks: Sequence[str]) -> DataFrame:
    """Add ``rank_<m>``, the average rank of ``value`` among the rows whose boolean ``m`` is true, and ``same_<m>``, how many of
    them have the row's value.

    One ordering, stored once, serves all masks; no row is joined by its value.  A NULL value must be filtered out first, and
    rows outside a mask have a rank between those around them.  A value that many rows share is spread over tasks; the runs
    at the ends of tasks, two for each, are put together by the driver.
    """
    rest = [c for c in df.columns if c != value]
    rows = df.select(value, *rest, F.pmod(F.monotonically_increasing_id(), F.lit(1 << 15)).cast("short").alias("_salt"))
    rows = rows.repartitionByRange(value, "_salt").drop("_salt").sortWithinPartitions(value).withColumn("_part", F.spark_partition_id())
    at = [rows.columns.index(m) for m in masks]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _edge tinyint" + "".join(f", _a{k} double, _s{k} bigint" for k in range(len(at)))
    placed = stored(rows.mapInArrow(lambda batches: _locally_ranked(batches, at), schema))
    counts = placed.groupBy("_part", "_edge").agg(F.max(value).alias("_v"), *[F.count_if(m).alias(f"_n{k}") for k, m in enumerate(masks)])
    parts = sorted(counts.collect(), key=lambda r: (r["_part"], (1, 0, 2)[r["_edge"]]))  # three rows for each task at most
    base, below, k = [], [0] * len(masks), 0
    while k < len(parts):
        end, edge = k + 1, parts[k]["_edge"]
        while edge and end < len(parts) and parts[end]["_edge"] and (parts[end]["_v"] == parts[k]["_v"] or parts[end]["_v"] != parts[end]["_v"] and parts[k]["_v"] != parts[k]["_v"]):
            end += 1  # one run over several tasks
        total = [sum(p[f"_n{m}"] for p in parts[k:end]) for m in range(len(masks))]
        for p in parts[k:end]:
            entry = (p["_part"], p["_edge"])
            for m, n in enumerate(total):
                # local ranks count the rows of the task's first run, the others of the group are earlier
                own = sum(q[f"_n{m}"] for q in parts[max(k - 1, 0) : k] if q["_part"] == p["_part"] and q["_edge"] == 1)
                entry += (below[m] + (n + 1) / 2.0, n) if edge else (float(below[m] - own), None)
            base.append(entry)
        below = [b + n for b, n in zip(below, total)]
        k = end
    names = "_part int, _edge tinyint" + "".join(f", _b{m} double, _w{m} bigint" for m in range(len(masks)))
    out = placed.join(F.broadcast(df.sparkSession.createDataFrame(base, names)), ["_part", "_edge"])
    added = [c for k, m in enumerate(masks) for c in ((F.col(f"_b{k}") + F.col(f"_a{k}")).alias(f"rank_{m}"), F.coalesce(f"_w{k}", f"_s{k}").alias(f"same_{m}"))]
    return out.select(*df.columns, *added)
