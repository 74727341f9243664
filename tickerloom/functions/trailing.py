"""Order statistics of trailing windows, which a window frame would sort or scan anew for every row.

Spark deals the rows out by ticker and orders them; numpy takes the windows of a batch as views
of one array.  A ticker's last rows wait for the next batch, so a task holds one batch and one
ticker, whose rows the calendar bounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

#: Windows turned into one matrix at once.
ROWS_AT_ONCE = 2048


def _windows(values: np.ndarray, rows: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(rows - 1, np.nan), values]), rows)


def _pieces(rows: np.ndarray) -> Iterator[np.ndarray]:
    return (rows[a : a + ROWS_AT_ONCE] for a in range(0, len(rows), ROWS_AT_ONCE))


def worst_moves(values: np.ndarray, place: np.ndarray, rows: int) -> np.ndarray:
    """Worst peak-to-trough move inside each full window; ``place`` numbers the rows of a ticker from 0."""
    windows, out = _windows(values, rows), np.full(len(values), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        for at in _pieces(np.flatnonzero(place >= rows - 1)):
            peaks = np.fmax.accumulate(windows[at], axis=1)
            peaks[peaks == 0] = np.nan
            out[at] = np.fmin.reduce(windows[at] / peaks, axis=1, initial=1.0) - 1
    return out


def medians(values: np.ndarray, known: np.ndarray, place: np.ndarray, rows: int, minimum: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of the known values of each window, and where fewer than ``minimum`` are known; a NaN is the largest value."""
    upto = np.concatenate([[0], np.cumsum(known)])
    end = np.arange(1, len(values) + 1)
    count = upto[end] - upto[end - np.minimum(place + 1, rows)]
    windows, out = _windows(np.where(known, values, np.nan), rows), np.full(len(values), np.nan)
    wanted = np.flatnonzero(count >= minimum)
    whole = count[wanted] == rows
    for at in _pieces(wanted[whole]):
        middle = np.partition(windows[at], ((rows - 1) // 2, rows // 2), axis=1)
        out[at] = (middle[:, (rows - 1) // 2] + middle[:, rows // 2]) / 2
    for at in _pieces(wanted[~whole]):
        own = np.where(np.arange(rows) >= (rows - 1 - place[at])[:, None], windows[at], np.nan)
        own.sort(axis=1)
        row, n = np.arange(len(at)), count[at]
        out[at] = (own[row, (n - 1) // 2] + own[row, n // 2]) / 2
    return out, count < minimum


def _typical(values: np.ndarray, known: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Median of a ticker's known values, on each of its rows."""
    out = np.full(len(values), np.nan)
    for a, b in zip(starts, [*starts[1:], len(values)]):
        own = np.sort(values[a:b][known[a:b]])
        if len(own):
            out[a:b] = 0.5 * own[(len(own) - 1) // 2] + 0.5 * own[len(own) // 2]
    return out


def _tickers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ordered batches, cut between tickers."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch["ticker"]).run_ends.to_numpy()
        if held and batch["ticker"][0] != held[-1]["ticker"][0]:
            yield pa.concat_batches(held)
            held = []
        if len(runs) > 1:
            yield pa.concat_batches([*held, batch.slice(0, int(runs[-2]))])
            held, batch = [], batch.slice(int(runs[-2]))
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def with_trailing(
    df: DataFrame, moves: Sequence[tuple[str, str, int]] = (), medians_of: Sequence[tuple[str, str, int, int]] = (), typical: Sequence[str] = ()
) -> DataFrame:
    """Add ``moves`` (output, column, rows), ``medians_of`` (output, column, rows, minimum) and for the medians named in
    ``typical`` their median over the whole ticker, as ``<output>_typical``."""
    added = [*(m[0] for m in moves), *(m[0] for m in medians_of), *(f"{t}_typical" for t in typical)]
    df = df.drop(*added)
    schema = StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _tickers(batches):
            ends = pc.run_end_encode(batch["ticker"]).run_ends.to_numpy().astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            place = np.arange(batch.num_rows) - np.repeat(starts, ends - starts)
            values = {c: batch[c].to_numpy(zero_copy_only=False).astype(float) for c in {m[1] for m in (*moves, *medians_of)}}
            out, null = {}, {}
            for name, x, rows in moves:
                out[name] = worst_moves(values[x], place, rows)
                null[name] = place < rows - 1
            for name, x, rows, minimum in medians_of:
                known = batch[x].is_valid().to_numpy(zero_copy_only=False)
                out[name], null[name] = medians(values[x], known, place, rows, minimum)
            for name in typical:
                out[f"{name}_typical"] = _typical(out[name], ~null[name], starts)
                null[f"{name}_typical"] = np.repeat(np.logical_and.reduceat(null[name], starts), ends - starts)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[n], mask=null[n]) for n in added)], [*batch.schema.names, *added])

    return df.repartition("ticker").sortWithinPartitions("ticker", "date").mapInArrow(run, schema)
