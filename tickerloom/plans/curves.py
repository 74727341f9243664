"""Classification curves of many overlapping groups from one ordering.

Rows are ordered once by (order key, probability, ties) and stored narrow: the
probability, a code for each scope, and for each label how many rows a row stands for
and how many of them are positive.  A scope is a list of key columns; a row belongs
to one group of each scope, so no row is repeated for the total, its fold and its
regime.  Two passes over the stored order follow: the first adds up every group, the
second, which knows how many rows lie below each stretch of the order, adds up areas,
average precisions and outer thirds.  The runs of one probability at the ends of a
stretch are put together by the driver, which holds a few numbers for each task and
group; groups must be few (folds, regimes, targets), not tickers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.plans.blocks import PARTIAL, summed
from tickerloom.plans.storage import stored

#: Sums of a group that need no order: rows, positives, probability, its square, probability of positives, rows and positives called.
ADDED = 7
#: Sums of the second pass: area, average precision, positives of the bottom and of the top third.
ORDERED = 4


@dataclass(frozen=True)
class Shape:
    sizes: tuple[int, ...]  # groups of each scope
    labels: int

    def columns(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        s = len(self.sizes)
        at, o, p, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        n, y = (np.column_stack(rest[s + k :: 2]).astype(float) for k in (0, 1))
        return at, o, p, np.column_stack(rest[:s]).astype(np.int64), n, y

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """``(first, ...)``: rows of one stretch, in order; ``first`` at its beginning."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            data = self.columns(batch)
            cuts = [0, *(np.flatnonzero(np.diff(data[0]) != 1) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = tuple(d[a:b] for d in data)
                yield last is None or part[0][0] != last + 1, part
                last = part[0][-1]

    def counts(self, codes: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        """For each scope (group, label, value) sums of rows x labels."""
        out = []
        for s, size in enumerate(self.sizes):
            total = np.zeros((size, self.labels, len(values)))
            for i, v in enumerate(values):
                for k in range(self.labels):
                    total[:, k, i] = np.bincount(codes[:, s], v[:, k], size)
            out.append(total)
        return out


@dataclass(frozen=True)
class Ordered:
    table: DataFrame  # _at, _o, _p, a code for each scope, rows and positives for each label
    shape: Shape


def _starts(o: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Starts of the runs of one order key and probability; NaN equals NaN."""
    same = (o[1:] == o[:-1]) & ((p[1:] == p[:-1]) | (np.isnan(p[1:]) & np.isnan(p[:-1])))
    return np.concatenate([[0], np.flatnonzero(~same) + 1])


def _equal(a: tuple, b: tuple) -> bool:
    return a[0] == b[0] and (a[1] == b[1] or (a[1] != a[1] and b[1] != b[1]))


def _plus(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b)]


@dataclass
class _Run:
    """Rows of one order key and probability: rows and positives by scope."""

    key: tuple
    counts: list[np.ndarray]


def _flat(arrays: list[np.ndarray]) -> bytes:
    return np.concatenate([a.ravel() for a in arrays]).tobytes()


def _unflat(data: bytes, sizes: Sequence[int], labels: int, width: int) -> list[np.ndarray]:
    flat, out, at = np.frombuffer(data, float), [], 0
    for size in sizes:
        n = size * labels * width
        out.append(flat[at : at + n].reshape(size, labels, width))
        at += n
    return out


def ordered(df: DataFrame, by: Sequence[str], probability: str, labels: Sequence[tuple[Column, Column]], scopes: Sequence[Sequence[str]], ties: Sequence[str] = ()) -> tuple[Ordered, list[list[tuple]]]:
    """``df`` in the order of (``by``, probability, ties), and the keys of each scope's groups; rows without a probability are left out.

    ``labels`` are pairs (rows, positives).  Scopes hold all columns of ``by``, as groups with different orders don't meet.
    """
    spark = df.sparkSession
    keys = list(dict.fromkeys([*by, *(c for s in scopes for c in s)]))
    df = df.filter(F.col(probability).isNotNull())
    found = [tuple(r) for r in df.select(*keys).distinct().collect()] if keys else [()]  # folds, regimes, targets
    groups = [list(dict.fromkeys(tuple(f[keys.index(c)] for c in s) for f in found)) for s in (by, *scopes)]
    places = [{g: i for i, g in enumerate(x)} for x in groups]
    coded = [(*f, *(places[i][tuple(f[keys.index(c)] for c in s)] for i, s in enumerate((by, *scopes)))) for f in found]
    names = [f"_k{i}" for i in range(len(keys))]
    codes = ["_o", *(f"_c{i}" for i in range(len(scopes)))]
    rows = df
    if keys:
        schema = ", ".join([*(f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keys)), *(f"{c} int" for c in codes)])
        on = F.lit(True)
        for n, k in zip(names, keys):
            on = on & F.col(k).eqNullSafe(F.col(n))
        rows = df.join(F.broadcast(spark.createDataFrame(coded, schema)), on)
    else:
        rows = df.withColumns({c: F.lit(0) for c in codes})
    pairs = [c.alias(f"{x}{k}") for k, pair in enumerate(labels) for x, c in zip(("_n", "_s"), pair)]
    ties = [F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)]
    rows = rows.select("_o", F.col(probability).cast("double").alias("_p"), *codes[1:], *pairs, *ties)
    order = ["_o", "_p", *(f"_t{i}" for i in range(len(ties)))]
    if not ties:
        rows = rows.withColumn("_t", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 15)).cast("short"))  # a frequent value lies in several tasks
        order.append("_t")
    table = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = [f"{x}{k}" for k in range(len(labels)) for x in ("_n", "_s")]
    shape = Shape(tuple(len(g) for g in groups[1:]), len(labels))
    return Ordered(stored(table.select("_at", "_o", "_p", *codes[1:], *kept)), shape), groups[1:]


def _totals(order: Ordered, threshold: float) -> list[dict]:
    """What each stretch adds up, and its first and last run, in order."""

    shape = order.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(state: dict) -> pa.RecordBatch:
            first, last = state["first"], state["last"]
            zero = [np.zeros((size, shape.labels, 2)) for size in shape.sizes]
            ends = [*first.key, *(last.key if last else (-1, 0.0))]
            columns = [pa.array([v], t) for v, t in zip((state["at"], *ends), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()))]
            blobs = [_flat(x) for x in (state["total"], first.counts, last.counts if last else zero)]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([b], pa.binary()) for b in blobs)], ["at", "o1", "p1", "o2", "p2", "total", "first", "last"])

        state: dict = {}
        for begins, (at, o, p, codes, n, y) in shape.pieces(batches):
            if begins:
                if state:
                    yield record(state)
                state = {"at": int(at[0]), "first": None, "last": None, "total": [np.zeros((size, shape.labels, ADDED)) for size in shape.sizes]}
            q, called = np.where(n > 0, p[:, None], 0.0), (p >= threshold)[:, None]
            state["total"] = _plus(state["total"], shape.counts(codes, n, y, n * q, n * q * q, y * q, n * called, y * called))
            starts = [int(x) for x in _starts(o, p)]
            for a, b in [(0, [*starts, len(p)][1]), (starts[-1], len(p))][: len(starts)]:
                run = _Run((int(o[a]), float(p[a])), shape.counts(codes[a:b], n[a:b], y[a:b]))
                if state["first"] is None:
                    state["first"] = run
                elif a == 0 and state["last"] is None and _equal(state["first"].key, run.key):
                    state["first"].counts = _plus(state["first"].counts, run.counts)
                elif a == 0 and state["last"] is not None and _equal(state["last"].key, run.key):
                    state["last"].counts = _plus(state["last"].counts, run.counts)
                else:
                    state["last"] = run
        if state:
            yield record(state)

    schema = "at bigint, o1 bigint, p1 double, o2 bigint, p2 double, total binary, first binary, last binary"
    out = []
    for r in order.table.mapInArrow(work, schema).collect():  # a few rows for each task
        sizes, labels = shape.sizes, shape.labels
        first = _Run((r.o1, r.p1), _unflat(r.first, sizes, labels, 2))
        last = _Run((r.o2, r.p2), _unflat(r.last, sizes, labels, 2)) if r.o2 >= 0 else None
        out.append({"at": r.at, "total": _unflat(r.total, sizes, labels, ADDED), "first": first, "last": last})
    return sorted(out, key=lambda x: x["at"])


def _met(run: np.ndarray, below: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Area and average precision of runs: (..., label, 2) of rows and positives, of what lies below, and of the group."""
    n, tp, low, hit = run[..., 0], run[..., 1], below[..., 0], below[..., 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        ap = np.where(tp > 0, tp / whole[..., 1] * (whole[..., 1] - hit) / (whole[..., 0] - low), 0.0)
    return np.stack([tp * (low - hit + (n - tp) / 2), ap], axis=-1)


def _added(codes: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (rows first) by code."""
    out = np.zeros((size, *values.shape[1:]))
    if len(values):
        starts = np.flatnonzero(np.concatenate([[True], np.diff(codes) != 0]))
        out[codes[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def _before(codes: np.ndarray, values: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For rows sorted by code: ``below`` of the code and the values of its earlier rows."""
    upto = np.cumsum(values, axis=0) - values
    starts = np.flatnonzero(np.concatenate([[True], np.diff(codes) != 0]))
    base = np.repeat(upto[starts], np.diff([*starts, len(codes)]), axis=0)
    return upto - base + below[codes]


@dataclass
class _Stretch:
    """What a task needs for a stretch: its end runs, which the driver has done, and what lies below."""

    first: tuple
    last: tuple | None
    runs: list[np.ndarray] = field(default_factory=list)  # below the first run after ``first``
    rows: list[np.ndarray] = field(default_factory=list)  # below the first row


def segment_sums(order: Ordered, threshold: float = 0.5, thirds: bool = False) -> list[np.ndarray]:
    """For each scope (group, label, ``ADDED`` + ``ORDERED``) sums.

    Thirds as by ``rank_bucket`` of the places in the order; every row then stands for at most one.
    """
    stretches = _totals(order, threshold)
    shape = order.shape
    sizes, labels = shape.sizes, shape.labels
    whole = [sum((s["total"][i] for s in stretches), np.zeros((size, labels, ADDED))) for i, size in enumerate(sizes)]
    done = [np.zeros((size, labels, ORDERED)) for size in sizes]
    below, waiting, plans = [np.zeros((size, labels, 2)) for size in sizes], None, {}
    rows = [np.zeros((size, labels)) for size in sizes]

    def close(run: _Run | None) -> None:
        nonlocal below
        if run:
            for i in range(len(sizes)):
                done[i][..., :2] += _met(run.counts[i], below[i], whole[i])
            below = _plus(below, run.counts)

    for s in stretches:
        first, last = s["first"], s["last"]
        if waiting and _equal(waiting.key, first.key):
            waiting = _Run(first.key, _plus(waiting.counts, first.counts))
        else:
            close(waiting)
            waiting = first
        plans[s["at"]] = _Stretch(first.key, last.key if last else None, [], rows)
        rows = [r + t[..., 0] for r, t in zip(rows, s["total"])]
        if last:
            close(waiting)
            plans[s["at"]].runs = below
            inner = [t[..., :2] - a - b for t, a, b in zip(s["total"], first.counts, last.counts)]
            below, waiting = _plus(below, inner), last
    close(waiting)
    size = [w[..., 0] for w in whole]
    edges = [(np.floor((n - 1) / 3) + 1, np.floor(2 * (n - 1) / 3) + 1) for n in size]
    shared = order.table.sparkSession.sparkContext.broadcast((plans, [w[..., :2] for w in whole], edges))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, whole, edges = shared.value
        found = [np.zeros((size, labels, ORDERED)) for size in sizes]
        plan, below, rows, open_ = None, [], [], None

        def close() -> None:
            nonlocal below, open_
            if open_:
                for i in range(len(sizes)):
                    found[i][..., :2] += _met(open_.counts[i], below[i], whole[i])
                below = _plus(below, open_.counts)
                open_ = None

        for begins, (at, o, p, codes, n, y) in shape.pieces(batches):
            if begins:
                close()
                plan = plans[int(at[0])]
                below, rows = plan.runs, plan.rows
            if thirds:
                for i, size in enumerate(sizes):
                    by = np.argsort(codes[:, i], kind="stable")
                    c, own, positive = codes[by, i], n[by], y[by]
                    place = _before(c, own, rows[i]) + own
                    outer = np.stack([positive * ((own > 0) & (place <= edges[i][0][c])), positive * ((own > 0) & (place > edges[i][1][c]))], axis=-1)
                    found[i][..., 2:] += _added(c, size, outer)
                    rows = [*rows[:i], rows[i] + _added(c, size, own), *rows[i + 1 :]]
            if plan.last is None:
                continue
            starts = _starts(o, p)
            ends = [*starts[1:], len(p)]
            if _equal(plan.first, (o[0], p[0])):
                starts, ends = starts[1:], ends[1:]
            if len(starts) and _equal(plan.last, (o[-1], p[-1])):
                starts, ends = starts[:-1], ends[:-1]
                if not len(starts):
                    close()
            if not len(starts):
                continue
            head = _Run((o[starts[0]], p[starts[0]]), shape.counts(codes[starts[0] : ends[0]], n[starts[0] : ends[0]], y[starts[0] : ends[0]]))
            if open_ and _equal(open_.key, head.key):
                head.counts = _plus(open_.counts, head.counts)
                open_ = None
            close()
            open_ = head
            if len(starts) == 1:
                continue
            close()
            a, b = int(starts[1]), int(starts[-1])  # whole runs
            if b > a:
                run = np.repeat(np.arange(len(starts) - 2), np.diff(starts[1:]))
                both = np.stack([n[a:b], y[a:b]], axis=-1)
                for i, size in enumerate(sizes):
                    by = np.lexsort((run, codes[a:b, i]))
                    c, r = codes[a:b, i][by], run[by]
                    cells = np.flatnonzero(np.concatenate([[True], (np.diff(c) != 0) | (np.diff(r) != 0)]))
                    counts, c = np.add.reduceat(both[by], cells, axis=0), c[cells]
                    found[i][..., :2] += _added(c, size, _met(counts, _before(c, counts, below[i]), whole[i][c]))
                    below = [*below[:i], below[i] + _added(c, size, counts), *below[i + 1 :]]
            open_ = _Run((o[b], p[b]), shape.counts(codes[b : ends[-1]], n[b : ends[-1]], y[b : ends[-1]]))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([_flat(found)], pa.binary())], ["key", "data"])

    parts = order.table.rdd.getNumPartitions()
    total = summed(order.table.mapInArrow(work, PARTIAL), parts, lambda key, total: (key, total.tobytes()), PARTIAL).first()
    if total is not None:
        done = _plus(done, _unflat(total.data, sizes, labels, ORDERED))
    return [np.concatenate([w, d], axis=-1) for w, d in zip(whole, done)]
