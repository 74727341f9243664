"""Exact quantiles of many calendar windows at once, by counting.

A window is an interval of days with a label that must be known; windows may
overlap, and no row is copied or sorted for them.  Numbers are compared by
unsigned integers in the same order (their bits).  Each (window, column, rank) has a
bracket of integers that holds the wanted order statistics.  One job per round
counts the rows of each bracket in equal steps, and keeps the steps that hold the
wanted ranks, so eight rounds settle any bracket.  One that holds few rows is read
out before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tickerloom.plans.blocks import Block, Blocks

STEPS = 256
#: Rows of a bracket that are read out instead of counted.
FEW = 32


@dataclass(frozen=True)
class Window:
    """Rows from day ``start`` to day ``end`` whose label (a place in the blocks' labels) is known, or all of them."""

    start: int
    end: int
    label: int | None = None

    def rows(self, block: Block) -> tuple[np.ndarray, np.ndarray | None]:
        """Values and labels of the window's rows in a block."""
        at = block.window(self.start, self.end)
        if self.label is None:
            return block.x[at], None
        y = block.y[at, self.label]
        known = ~np.isnan(y)
        return (block.x[at], y) if known.all() else (block.x[at][known], y[known])


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers."""
    bits = (x + 0.0).view(np.uint64)
    return bits ^ np.where(bits >> np.uint64(63), np.uint64(2**64 - 1), np.uint64(2**63))


def _number(k: np.ndarray) -> np.ndarray:
    """The numbers of ``_ordered``."""
    k = np.asarray(k, np.uint64)
    return (k ^ np.where(k >> np.uint64(63), np.uint64(2**63), np.uint64(2**64 - 1))).view(float)


@dataclass
class Summary:
    """Per window and column: known rows, least and greatest value; per window: rows and sum of the label."""

    known: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    positive: np.ndarray


def summarize(blocks: Blocks, windows: Sequence[Window]) -> Summary:
    """One pass.  Extremes travel as the values themselves, counts and sums next to them."""
    width = len(blocks.values)
    shared = blocks.table.sparkSession.sparkContext.broadcast(list(windows))

    def work(parts: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for block in parts:
            for k, window in enumerate(shared.value):
                if window.start > block.days[-1] or window.end < block.days[0]:
                    continue
                x, y = window.rows(block)
                if not len(x):
                    continue
                known = ~np.isnan(x)
                low, high = np.where(known, x, np.inf).min(axis=0), np.where(known, x, -np.inf).max(axis=0)
                sums = np.array([len(x), 0 if y is None else y.sum(), *known.sum(axis=0)], float)
                if k in found:
                    a, b, c = found[k]
                    found[k] = [np.minimum(a, low), np.maximum(b, high), c + sums]
                else:
                    found[k] = [low, high, sums]
        for k, arrays in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], ["key", "low", "high", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        low, high, sums = (np.stack([np.frombuffer(v.as_buffer(), float) for v in table[c]]) for c in ("low", "high", "sums"))
        merged = (low.min(axis=0), high.max(axis=0), sums.sum(axis=0))
        return pa.table([table["key"][:1], *(pa.array([a.tobytes()], pa.binary()) for a in merged)], names=["key", "low", "high", "sums"])

    schema = "key bigint, low binary, high binary, sums binary"
    done = blocks.map(work, schema).groupBy("key").applyInArrow(merge, schema).collect()  # one row per window
    n = len(windows)
    out = Summary(np.zeros((n, width)), np.full((n, width), np.inf), np.full((n, width), -np.inf), np.zeros(n), np.zeros(n))
    for r in done:
        sums = np.frombuffer(r.sums, float)
        out.low[r.key], out.high[r.key] = np.frombuffer(r.low, float), np.frombuffer(r.high, float)
        out.rows[r.key], out.positive[r.key], out.known[r.key] = sums[0], sums[1], sums[2:]
    return out


def quantiles(blocks: Blocks, windows: Sequence[Window], probabilities: Sequence[float], summary: Summary | None = None) -> np.ndarray:
    """Linearly interpolated quantiles, by window, column and probability; NaN where no row is known.

    The driver holds the brackets: windows x columns x probabilities numbers.
    """
    summary = summary or summarize(blocks, windows)
    known = summary.known[:, :, None]
    rank = np.maximum(known - 1, 0) * np.asarray(probabilities)  # place of the wanted value, from 0
    first = np.floor(rank)
    found = _selected(blocks, windows, summary, np.concatenate([first, np.minimum(first + 1, np.maximum(known - 1, 0))], axis=2))
    below, above = np.split(found, 2, axis=2)
    return below + (above - below) * (rank - first)


def _selected(blocks: Blocks, windows: Sequence[Window], summary: Summary, wanted: np.ndarray) -> np.ndarray:
    """Order statistics ``wanted`` (places from 0) by window, column and request."""
    spark = blocks.table.sparkSession
    low, high = (np.broadcast_to(_ordered(a)[:, :, None], wanted.shape).copy() for a in (summary.low, summary.high))
    inside = np.broadcast_to(summary.known[:, :, None], wanted.shape).copy()  # rows of the bracket
    place = wanted.copy()  # in the bracket
    out = np.full(wanted.shape, np.nan)
    open_ = inside > 0
    while True:
        single = open_ & (low == high)
        out[single] = _number(low[single])
        open_ &= ~single
        todo = np.argwhere(open_ & (inside > FEW))
        if not len(todo):
            break
        at = tuple(todo.T)
        counts = _counted(blocks, windows, todo, low[at], high[at], spark)
        upto = np.cumsum(counts, axis=1)
        step, rows = (upto <= place[at][:, None]).sum(axis=1), np.arange(len(todo))
        width = _width(low[at], high[at])
        inside[at] = counts[rows, step]
        place[at] -= upto[rows, step] - counts[rows, step]
        start = step.astype(np.uint64) * width
        low[at], high[at] = low[at] + start, low[at] + np.minimum(start + (width - np.uint64(1)), high[at] - low[at])
    todo = np.argwhere(open_)
    if len(todo):
        for (w, c, q), values in zip(todo, _read_out(blocks, windows, todo, low, high, spark)):
            out[w, c, q] = values[int(place[w, c, q])]
    return out


def _width(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Width of the steps of a bracket."""
    return (high - low) // np.uint64(STEPS) + np.uint64(1)


def _by_window(todo: np.ndarray) -> dict[int, np.ndarray]:
    """Places in ``todo`` of each window's brackets."""
    cuts = np.flatnonzero(np.diff(todo[:, 0])) + 1
    return {int(todo[k[0], 0]): k for k in np.split(np.arange(len(todo)), cuts)}


def _counted(blocks: Blocks, windows: Sequence[Window], todo: np.ndarray, low: np.ndarray, high: np.ndarray, spark) -> np.ndarray:
    """Rows in each step of each bracket."""
    steps = STEPS
    shared = spark.sparkContext.broadcast((list(windows), _by_window(todo), todo[:, 1], low, high, _width(low, high)))

    def work(parts: Iterator[Block]) -> dict[int, np.ndarray]:
        known_windows, groups, columns, lows, highs, widths = shared.value
        found: dict[int, np.ndarray] = {}
        for block in parts:
            for w, at in groups.items():
                window = known_windows[w]
                if window.start > block.days[-1] or window.end < block.days[0]:
                    continue
                x = window.rows(block)[0][:, columns[at]]
                v = _ordered(x)
                row, place = np.nonzero((v >= lows[at]) & (v <= highs[at]) & ~np.isnan(x))
                k = ((v[row, place] - lows[at][place]) // widths[at][place]).astype(np.int64)
                counts = np.bincount(place * steps + k, minlength=len(at) * steps).astype(float)
                found[w] = found[w] + counts if w in found else counts
        return found

    done = blocks.totals(work, lambda key, total: (key, total.tobytes()), "key bigint, data binary").collect()
    out = np.zeros((len(todo), steps))
    groups = _by_window(todo)
    for r in done:
        out[groups[r.key]] = np.frombuffer(r.data, float).reshape(-1, steps)
    return out


def _read_out(blocks: Blocks, windows: Sequence[Window], todo: np.ndarray, low: np.ndarray, high: np.ndarray, spark) -> list[np.ndarray]:
    """The sorted values of each bracket, at most ``FEW`` each."""
    at = tuple(todo.T)
    shared = spark.sparkContext.broadcast((list(windows), _by_window(todo), todo[:, 1], low[at], high[at]))

    def work(parts: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        known_windows, groups, columns, lows, highs = shared.value
        for block in parts:
            keys, values = [], []
            for w, mine in groups.items():
                window = known_windows[w]
                if window.start > block.days[-1] or window.end < block.days[0]:
                    continue
                x = window.rows(block)[0][:, columns[mine]]
                v = _ordered(x)
                row, place = np.nonzero((v >= lows[mine]) & (v <= highs[mine]) & ~np.isnan(x))
                keys.append(mine[place])
                values.append(x[row, place])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(values))], ["key", "value"])

    rows = blocks.map(work, "key bigint, value double").toArrow()  # bounded: FEW values for each bracket
    key, value = rows["key"].to_numpy(), rows["value"].to_numpy()
    order = np.lexsort((value, key))
    starts = np.searchsorted(key[order], np.arange(len(todo) + 1))
    return [value[order[a:b]] for a, b in zip(starts[:-1], starts[1:])]
