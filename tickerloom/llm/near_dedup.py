"""Near-duplicate documents by SetSketch registers.

A document's set holds the hashes of its distinct word shingles.  A SetSketch has
``registers`` values ``floor(1 - log_b(h))``, where h is the smallest of the set's
exponential hash values with rate ``rate``, truncated to 0 .. top + 1.  Registers
of a union are the maxima of the registers, and two equal registers mean (up to
the spacing b) that both sets share that minimum, so sketches are mergeable and
locality-sensitive.

1. Sketch every document in one pass; equal sets form one class with one node.
2. Band the registers.  In each bucket every member is paired only with the
   bucket's most popular member (the one that meets most others over all bands),
   so pairs grow linearly with a bucket.
3. Estimate the similarity of a pair jointly by maximum likelihood from how many
   registers are larger, smaller and equal; drop what is far below the threshold,
   verify the rest on the full sets, and form components.
4. Buckets whose members are still in several components are compared in blocks of
   bounded bytes on full sets: members are compared with all others until those not
   yet compared are in one component.  A block reports only links that join two
   components.  So every pair
   that shares a bucket is decided exactly or already connected, and no list of all
   pairs is made.

Sets are compared as sets of 64-bit shingle hashes.  A pair at the threshold
shares no bucket with a probability under ``miss``.

Defined cases: a null, empty or blank text has no shingles and is linked with
nothing; a text with fewer words than a shingle is one shingle; a row with a null
id is linked with nothing and kept; rows that repeat an id are one node; a very long
text is one row; an empty table gives an empty result.  Columns other than id and
text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import bounded_broadcast, free_names, slices, texts_of, written
from tickerloom.plans.storage import settle

#: Ids of candidate documents are broadcast up to this number (16 MB), else joined by a shuffle.
BROADCAST_IDS = 1_000_000
BLOCK_BYTES = 4 << 20
_MIX = np.random.default_rng(20_240_607).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Sketch:
    registers: int = 120
    base: float = 1.001
    rate: float = 20.0
    top: int = 65_534
    seed: int = 1

    def multipliers(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 1 << 63, self.registers, np.uint64) * np.uint64(2) + np.uint64(1)

    def values(self, hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
        """Registers of one set of hashes."""
        low = np.full(self.registers, ~np.uint64(0))
        for a in range(0, len(hashes), 1024):
            low = np.minimum(low, (hashes[a : a + 1024, None] * multipliers).min(axis=0))
        exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / self.rate
        return np.clip(np.floor(1 - np.log(exponential) / np.log(self.base)), 0, self.top + 1).astype("<u2")

    def bands(self, similarity: float, miss: float = 1e-5) -> int:
        """Most registers per band such that a pair at the threshold is missed less often than ``miss``."""
        fit = [r for r in range(1, 9) if (1 - similarity**r) ** (self.registers // r) <= miss]
        return max(fit, default=1)

    def estimate(self, u: np.ndarray, v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
        """Most likely similarity of every pair of sketches (rows of u and v) with set sizes n_u and n_v."""
        larger, smaller = (u > v).sum(axis=1), (u < v).sum(axis=1)
        same = self.registers - larger - smaller
        a, b = n_u / (n_u + n_v), n_v / (n_u + n_v)
        chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (self.base - 1) / self.base) / np.log(self.base)

        def likelihood(j: np.ndarray) -> np.ndarray:
            p, q = chance(a - b * j), chance(b - a * j)
            log = lambda x: np.log(np.maximum(x, 1e-12))
            return larger * log(p) + smaller * log(q) + same * log(1 - p - q)

        low, high = np.zeros(len(a)), np.minimum(a / b, b / a)
        for _ in range(40):  # the likelihood has one maximum: narrow by thirds
            left, right = low + (high - low) / 3, high - (high - low) / 3
            worse = likelihood(left) < likelihood(right)
            low, high = np.where(worse, left, low), np.where(worse, high, right)
        return (low + high) / 2


def shingles(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    hashed = np.fromiter((h for s in split for h in map(xxhash.xxh3_64_intdigest, s)), np.uint64, sum(map(len, split)))
    start = 0
    for s in split:
        own = hashed[start : start + len(s)]
        start += len(s)
        k = min(words, len(s))
        total = np.zeros(max(0, len(s) - k + 1) if s else 0, np.uint64)
        for i in range(k):
            total += own[i : i + len(total)] * _MIX[i]
        total += _MIX[63 - k]
        total ^= total >> np.uint64(31)
        total *= _MIX[40]
        total ^= total >> np.uint64(29)
        yield np.unique(total)


def sketches(docs: DataFrame, words: int, sketch: Sketch) -> DataFrame:
    """doc_id, n (set size), print (of the set), registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = sketch.multipliers()
        for part in slices(batches):
            sizes, prints, registers = [], [], []
            for own in shingles(texts_of(part), words):
                sizes.append(len(own))
                prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                registers.append(sketch.values(own, multipliers).tobytes() if len(own) else None)
            columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "print", "registers"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, print binary, registers binary")


def sets(docs: DataFrame, words: int) -> DataFrame:
    """id, hashes: the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [s.tobytes() for s in shingles(texts_of(part), words)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], ["id", "hashes"])

    return docs.mapInArrow(run, "id bigint, hashes binary")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0


def plausible(pairs: DataFrame, classes: DataFrame, sketch: Sketch, percent: int) -> DataFrame:
    """Pairs whose sizes allow a link and whose estimate is not far below the threshold."""
    j = percent / 100
    least = j - 5 * np.sqrt(j * (1 - j) / sketch.registers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, v = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (2, 3))
                n_u, n_v = (batch.column(k).to_numpy().astype(float) for k in (4, 5))
                keep = sketch.estimate(u, v, n_u, n_v) >= least
                keep &= 100 * np.minimum(n_u, n_v) >= percent * np.maximum(n_u, n_v)
                yield batch.filter(pa.array(keep)).select([0, 1])

    side = lambda x, k: classes.select(F.col("id").alias(x), F.col("registers").alias(f"r{k}"), F.col("n").alias(f"n{k}"))
    both = pairs.join(side("a", 1), "a").join(side("b", 2), "b").select("a", "b", "r1", "r2", "n1", "n2")
    return both.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                same = _shared(x, y)
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    side = lambda x, k: full.select(F.col("id").alias(x), F.col("hashes").alias(f"s{k}"))
    both = pairs.join(side("a", 1), "a").join(side("b", 2), "b").select("a", "b", "s1", "s2")
    return both.mapInArrow(run, "a bigint, b bigint")


def joining_links(ids: list[int], roots: list[int], half: list[int], own: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of one block that join two components.  ``half`` differs between the two parts of a
    block of two parts, where only pairs across them count; it is the same in a block of one."""
    n, across = len(ids), len(set(half)) > 1
    place = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    group = np.array([place[r] for r in roots])
    part = np.array(half)
    size = np.array([len(x) for x in own], np.int64)
    _, code = np.unique(np.concatenate(own), return_inverse=True)
    holder = np.repeat(np.arange(n), size)
    order = np.argsort(code, kind="stable")
    posting = holder[order]
    ends = np.cumsum(np.bincount(code))
    begins = ends - np.bincount(code)
    first = np.cumsum(size) - size
    found = []
    order = np.argsort(np.bincount(group)[group], kind="stable")
    waiting = np.ones(n, bool)  # not compared with all others yet
    while True:
        # Pairs of rows that still wait are settled only when all of them are in one component.
        other = waiting & (group != np.bincount(group[waiting]).argmax())
        if not other.any():
            break
        y = order[other[order].argmax()]
        waiting[y] = False
        mine = code[first[y] : first[y] + size[y]]
        lengths = ends[mine] - begins[mine]
        at = np.arange(lengths.sum()) + np.repeat(begins[mine] - (np.cumsum(lengths) - lengths), lengths)
        same = np.bincount(posting[at], minlength=n)
        near = (100 * same >= percent * (size + size[y] - same)) & (group != group[y])
        if across:
            near &= part != part[y]
        for x in np.flatnonzero(near):
            if group[x] != group[y]:
                found.append((ids[x], ids[y]))
                group[group == group[y]] = group[x]
    return found


def digest(id_col: str) -> list[Column]:
    """128 bits, as who_1 and who_2, of a group's distinct ids in any order; merges map-side, so no list of a bucket's members is made."""
    return [F.bit_xor(F.xxhash64(F.lit(k), F.col(id_col))).alias(f"who_{k}") for k in (1, 2)]


def components(links: DataFrame) -> DataFrame:
    """id, component: the smallest id of the component of every linked id, by alternating large and small stars."""
    turned = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, before = settle(turned(links)), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settle(turned(moved.unionByName(small.select("a", F.col("m").alias("b")))))


def near_dedup(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", sketch: Sketch = Sketch()
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their
    sets of ``words``-word shingles.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(sketches(docs, words, sketch), "sketches")
    nodes = rows.filter("doc_id IS NOT NULL AND n > 0").groupBy("print")
    classes = written(nodes.agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("registers").alias("registers")), "classes")

    width = sketch.bands(percent / 100)
    key = [F.xxhash64(F.lit(k), F.substring("registers", 1 + 2 * width * k, 2 * width)) for k in range(sketch.registers // width)]
    banded = classes.select("id", "n", F.explode(F.array(*key)).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(banded.join(shared, "key"), "members")

    popular = members.groupBy("id").agg(F.sum("size").alias("meets"))
    pivots = members.join(popular, "id").groupBy("key").agg(F.max_by("id", F.struct("meets", -F.col("id"))).alias("pivot"))
    stars = members.join(pivots, "key").filter("id <> pivot")
    stars = stars.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    candidates = settle(plausible(stars, classes, sketch, percent))

    ids = members.select(F.col("id").alias("doc_id")).distinct()
    full = written(sets(docs.join(bounded_broadcast(ids, BROADCAST_IDS), "doc_id", "left_semi"), words), "sets")
    links = settle(verified(candidates, full, percent))
    rooted = components(links)

    own = members.filter("size > 2").join(rooted, "id", "left").withColumn("root", F.coalesce("component", "id"))
    blocks = own.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("total"), F.count("*").alias("held"), *digest("id")
    )
    blocks = blocks.filter("low <> high").groupBy("held", "who_1", "who_2").agg(F.min("key").alias("key"), F.first("total").alias("total"))
    blocks = blocks.select("key", F.ceil(F.col("total") * 8 / BLOCK_BYTES).cast("int").alias("parts"))
    dealt = own.select("key", "id", "root").join(blocks, "key").withColumn("half", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("half", "other"), "k": F.greatest("half", "other")}).drop("parts", "other")

    def compare(table: pa.Table) -> pa.Table:
        one = table["i"][0].as_py() == table["k"][0].as_py()
        half = [0] * table.num_rows if one else table["half"].to_pylist()
        own = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        found = joining_links(table["id"].to_pylist(), table["root"].to_pylist(), half, own, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    more = dealt.join(full, "id").groupBy("key", "i", "k").applyInArrow(compare, "a bigint, b bigint")
    merged = components(links.unionByName(more))

    known = classes.select("print", F.col("id").alias("class_id")).join(merged.withColumnRenamed("id", "class_id"), "class_id", "left")
    known = known.select("print", F.coalesce("component", "class_id").alias("component_id"))
    linked = rows.filter("doc_id IS NOT NULL AND n > 0").select("doc_id", "n", "print").join(known, "print").select("doc_id", "n", "component_id")
    alone = rows.filter("doc_id IS NULL OR n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document stays: one id of each component, and rows with a null id."""
    (name,) = free_names(docs, "kept_id")
    kept = settle(near_dedup(docs, words, percent, id_col, text_col).filter("kept").select(F.col("doc_id").alias(name)))
    return docs.join(kept.distinct(), F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
