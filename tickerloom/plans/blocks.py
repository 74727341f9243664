"""A panel as numeric blocks, for jobs that read every row many times.

Rows are range-partitioned by date and packed, some thousand at a time, into one
matrix of values and one of labels.  A block knows its dates, so a task touches
only the calendar windows that meet them, and a later pass reads packed numbers
instead of columns.  The blocks are written once to the shared folder: losing an
executor costs a re-read.

``totals`` adds up what tasks found, array by array and key by key, over a tree of
shuffles, and finishes each key where its sum is complete.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.plans.storage import checkpoint_dir

ROWS = 4096
#: Partial sums of one key that one task adds up, at most; beyond it a second level does.
BRANCHES = 64
_SCHEMA = "first int, last int, days binary, rows binary, x binary, y binary"


@dataclass(frozen=True)
class Block:
    """Rows in order of their day (days since 1970); ``rows`` are hashes that tell rows apart, NaN is NULL."""

    days: np.ndarray
    rows: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def window(self, start: int, end: int) -> slice:
        """Rows whose day is from ``start`` to ``end``."""
        return slice(int(np.searchsorted(self.days, start, "left")), int(np.searchsorted(self.days, end, "right")))


def _numbers(columns: Sequence[np.ndarray], values: int) -> tuple[np.ndarray, ...]:
    """Days, row hashes, and the matrices of ``values`` columns and of the labels after them."""
    x, y = (np.ascontiguousarray(np.column_stack(c), float) if c else np.empty((len(columns[0]), 0)) for c in (columns[2 : 2 + values], columns[2 + values :]))
    x[~np.isfinite(x)] = np.nan
    return columns[0].astype(np.int32), columns[1].astype(np.int64), x, y


def _packed(batches: Iterator[pa.RecordBatch], values: int) -> Iterator[pa.RecordBatch]:
    def block(rows: pa.Table) -> pa.RecordBatch:
        data = _numbers([c.to_numpy() for c in rows.columns], values)
        first, last = int(data[0][0]), int(data[0][-1])
        return pa.RecordBatch.from_arrays(
            [pa.array([first], pa.int32()), pa.array([last], pa.int32()), *(pa.array([d.tobytes()], pa.binary()) for d in data)],
            ["first", "last", "days", "rows", "x", "y"],
        )

    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, ROWS - held)
            batch = batch.slice(part.num_rows)
            waiting.append(part)
            held += part.num_rows
            if held == ROWS:
                yield block(pa.Table.from_batches(waiting))
                waiting, held = [], 0
    if held:
        yield block(pa.Table.from_batches(waiting))


@dataclass(frozen=True)
class Blocks:
    table: DataFrame
    values: tuple[str, ...]
    labels: tuple[str, ...]
    parts: int

    def map(self, work: Callable[[Iterator[Block]], Iterator[pa.RecordBatch]], schema: str, days: tuple[int, int] | None = None) -> DataFrame:
        """``work`` over the blocks of each task; with ``days``, over those that meet them only."""
        table = self.table if days is None else self.table.filter((F.col("last") >= days[0]) & (F.col("first") <= days[1]))
        width, labels = len(self.values), len(self.labels)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def decoded() -> Iterator[Block]:
                for batch in batches:
                    for k in range(batch.num_rows):
                        days, rows, x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in enumerate((np.int32, np.int64, float, float), 2))
                        yield Block(days, rows, x.reshape(len(days), width), y.reshape(len(days), labels))

            yield from work(decoded())

        return table.mapInArrow(run, schema)

    def totals(
        self, work: Callable[[Iterator[Block]], dict[int, np.ndarray]], finish: Callable[[int, np.ndarray], tuple], schema: str, days: tuple[int, int] | None = None
    ) -> DataFrame:
        """``finish(key, total)`` for each key of the arrays that ``work`` returns in each task; ``schema`` names its result."""

        def partial(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            for key, array in work(blocks).items():
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([array.tobytes()], pa.binary())], ["key", "data"])

        return summed(self.map(partial, PARTIAL, days), self.parts, finish, schema)


class Scanned(Blocks):
    """Blocks cut from the rows of a stored table on each pass; a batch is put in order of its days when it is read.

    Nothing is copied, but a task may meet all windows, so its sums are as many as the windows.
    """

    def map(self, work: Callable[[Iterator[Block]], Iterator[pa.RecordBatch]], schema: str, days: tuple[int, int] | None = None) -> DataFrame:
        table = self.table if days is None else self.table.filter(F.col("day").between(*days))
        width = len(self.values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def cut() -> Iterator[Block]:
                for batch in batches:
                    if batch.num_rows:
                        data = _numbers([c.to_numpy(zero_copy_only=False) for c in batch.columns], width)
                        order = np.argsort(data[0], kind="stable")
                        yield Block(*(d[order] for d in data))

            yield from work(cut())

        return table.mapInArrow(run, schema)


#: What ``summed`` adds up: arrays of doubles by key.
PARTIAL = "key bigint, data binary"


def summed(partials: DataFrame, parts: int, finish: Callable[[int, np.ndarray], tuple], schema: str) -> DataFrame:
    """``finish(key, total)`` for each key of ``partials``, which ``parts`` tasks made."""
    if parts > BRANCHES:
        partials = partials.withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(parts // BRANCHES + 1)))
        partials = partials.repartition("key", "branch").drop("branch").sortWithinPartitions("key").mapInArrow(_added, PARTIAL)
    partials = partials.repartition("key").sortWithinPartitions("key")

    names, types = zip(*(f.split() for f in schema.split(", ")))
    arrow = [{"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[t] for t in types]

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, total in _sums(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(finish(key, total), arrow)], list(names))

    return partials.mapInArrow(done, schema)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Sum of the arrays of each key; keys come one after the other."""
    now, total = None, None
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            array = np.frombuffer(data.as_buffer(), float)
            if key == now:
                total += array
            else:
                if now is not None:
                    yield now, total
                now, total = key, array.copy()
    if now is not None:
        yield now, total


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, total in _sums(batches):
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["key", "data"])


def _rows(panel: DataFrame, values: Sequence[str], labels: Sequence[str], day: str | None, ids: Sequence[str]) -> DataFrame:
    at = F.unix_date(F.to_date(day)) if day else F.lit(0)
    key = F.xxhash64(*ids) if ids else F.monotonically_increasing_id()
    columns = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate((*values, *labels))]
    return panel.select(at.alias("day"), key.alias("row"), *columns)


def blocks(panel: DataFrame, values: Sequence[str], labels: Sequence[str], day: str | None = "date", ids: Sequence[str] = ("ticker", "date")) -> Blocks:
    """Blocks of the named columns; without a day all rows lie on day 0."""
    values, labels = tuple(dict.fromkeys(values)), tuple(dict.fromkeys(labels))
    rows = _rows(panel, values, labels, day, ids)
    rows = rows.repartitionByRange("day", "row").sortWithinPartitions("day", "row")
    width = len(values)
    path = f"{checkpoint_dir(panel.sparkSession)}/blocks-{uuid.uuid4().hex}"
    rows.mapInArrow(lambda batches: _packed(batches, width), _SCHEMA).write.parquet(path)
    table = panel.sparkSession.read.schema(_SCHEMA).parquet(path)
    return Blocks(table, values, labels, table.rdd.getNumPartitions())


def scanned(panel: DataFrame, values: Sequence[str], labels: Sequence[str], day: str | None = "date", ids: Sequence[str] = ("ticker", "date")) -> Blocks:
    """``blocks`` of a stored panel without a copy; rows with no day are left out, as no window has them."""
    values, labels = tuple(dict.fromkeys(values)), tuple(dict.fromkeys(labels))
    rows = _rows(panel, values, labels, day, ids).filter("day IS NOT NULL")
    return Scanned(rows, values, labels, rows.rdd.getNumPartitions())
