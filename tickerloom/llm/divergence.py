"""Audit of how the term use of a language's sources diverges, by count-level bitmaps.

A group is one (lang, source); its share of a term is p = 1 + floor(SCALE * (count + 1)
/ (N + V)) with N the group's occurrences of the V kept terms of its language.  The
divergence of a share p from q is f(p, q) = floor((p - q)^2 / q).

1. Terms are counted per slice of documents, then summed by (lang, source, term):
   one narrow shuffle with map-side sums.  A language keeps the terms of at least
   ``least`` of its documents.
2. A language's kept terms are dealt by hash into blocks of a bounded number of
   counts, so that no language, source or term fills a task.  In a block the terms
   are numbered from the most frequent down, and each (group, count) has a bitset of
   its term numbers, held as its non-zero 64-bit words.
3. For each two groups, AND and popcount of their bitsets give the number n of terms
   with counts a here and b there.  A cell adds n * (f(a, b) - f(a, 0) - f(0, b)
   + f(0, 0)), in both directions.
4. Zeros follow by complement: each group's number of terms per count, joined to the
   other groups of its language, adds n * (f(a, 0) - f(0, 0)) and n * (f(0, b)
   - f(0, 0)), and V * f(0, 0) stands for all terms.

All arithmetic is exact: shares are divided as decimals, and no sum of f over all terms
of a language exceeds 64 bits (it is at most about SCALE^2, as shares sum to about SCALE).

Defined cases: null text, language and source are empty strings, as groups of their
own; a row is a document, so repeated rows count again; texts without terms, and
languages without kept terms, still have their groups, with divergence 0; equal values
are ordered by item; an empty table gives an empty result.  Very long texts are counted
in pieces.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import bounded_broadcast, picked, slices, written

SCALE = 1_000_000_000
#: Counts (rows) of a block, about.
BLOCK_ROWS = 200_000
#: Pairs of bitset words looked at together.
CELLS = 1 << 20
#: Entries that a task counts before it hands them on.
ENTRIES = 300_000
PIECE_BYTES = 1 << 20
#: Rows of a table of groups that is broadcast.
FEW_GROUPS = 20_000

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text with its terms between spaces, in pieces that cut no term."""
    start = 0
    while start < len(text):
        stop = start + PIECE_BYTES
        piece = text[start:stop].translate(_LETTERS)
        while stop < len(text) and not piece.endswith(b" "):
            more = text[stop : stop + 4096].translate(_LETTERS)
            cut = more.find(b" ") + 1 or len(more)
            piece, stop = piece + more[:cut], stop + cut
        yield piece
        start = stop


class _Counts:
    """Occurrences and documents of (lang, source, term), handed on when there are many."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.uses: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def add(self, group: tuple[str, str], text: bytes) -> None:
        uses, seen = self.uses[group], set()
        for piece in _pieces(text):
            terms = piece.split()
            uses.update(terms)
            seen.update(terms)
        self.docs[group].update(seen)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), uses in self.uses.items():
            terms, docs = list(uses), self.docs[lang, source]
            terms.append(None)  # keeps groups without terms
            columns = [
                pa.array([lang] * len(terms)),
                pa.array([source] * len(terms)),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([uses[t] for t in terms], pa.int64()),
                pa.array([docs[t] for t in terms], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "uses", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, uses, docs; one more row with a null term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for part in slices(batches):
            lang, source, text = (c.fill_null("").to_pylist() for c in part.columns)
            for group, t in zip(zip(lang, source), text):
                counts.add(group, t.encode())
            if sum(map(len, counts.uses.values())) > ENTRIES:
                yield from counts.batches()
                counts.clear()
        yield from counts.batches()

    rows = docs.selectExpr(f"`{lang_col}` AS lang", f"`{source_col}` AS source", f"`{text_col}` AS text")
    partial = rows.mapInArrow(run, "lang string, source string, term string, uses bigint, docs bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))


def share(uses: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (uses + 1) / (total + terms)), exact for any 64-bit counts."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (uses + 1).cast("decimal(19,0)")
    return F.call_function("div", wide, (total + terms).cast("decimal(19,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    """f(p, q), null where q is null."""
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _joint(batch: pa.Table) -> pa.Table:
    """lang, source, item, joint: sums over the cells of each two groups of a block that share terms."""
    lang = batch.column("lang")[0].as_py()
    names = batch.column("source").combine_chunks().dictionary_encode()
    source = names.indices.to_numpy().astype(np.int64)
    names = names.dictionary
    terms = batch.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    uses, p, p0 = (batch.column(c).to_numpy() for c in ("uses", "p", "p0"))
    zero = np.zeros(len(names), np.int64)
    zero[source] = p0
    # number the terms of the block from the most frequent down
    frequency = np.zeros(int(terms.max()) + 1, np.int64)
    np.add.at(frequency, terms, uses)
    number = np.empty(len(frequency), np.int64)
    number[np.argsort(-frequency, kind="stable")] = np.arange(len(frequency))
    number = number[terms]
    # one entry for each non-zero word of each (group, count) bitset, ordered by word and group
    order = np.lexsort((uses, source, number >> 6))
    key = np.stack([number >> 6, source, uses])[:, order]
    head = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
    bits = np.bitwise_or.reduceat(np.uint64(1) << (number[order] & 63).astype(np.uint64), head)
    word, group, p = key[0, head], key[1, head], p[order][head]
    after = np.searchsorted(word * len(names) + group, word * len(names) + group, "right")  # entries of later groups
    last = np.searchsorted(word, word, "right")
    here, there = (np.zeros((len(names), len(names)), np.int64) for _ in range(2))
    partners = last - after
    ends = np.cumsum(partners)
    start = 0
    while start < len(word):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CELLS, "right")))
        n = partners[start:stop]
        i, j = np.repeat(np.arange(start, stop), n), picked(after[start:stop], n)
        cells = np.bitwise_count(bits[i] & bits[j]).astype(np.int64)
        some = cells > 0
        i, j, cells = i[some], j[some], cells[some]
        a, b, a0, b0 = p[i], p[j], zero[group[i]], zero[group[j]]
        np.add.at(here, (group[i], group[j]), cells * (_f(a, b) - _f(a, b0) - _f(a0, b) + _f(a0, b0)))
        np.add.at(there, (group[j], group[i]), cells * (_f(b, a) - _f(b, a0) - _f(b0, a) + _f(b0, a0)))
        start = stop
    sums = here + there
    one, other = np.nonzero(sums)
    columns = [pa.array([lang] * len(one), pa.string()), names.take(pa.array(one)), names.take(pa.array(other)), pa.array(sums[one, other])]
    return pa.table(columns, ["lang", "source", "item", "joint"])


class Audit:
    """Counts of a table of documents, written once, and what follows from them."""

    def __init__(self, docs: DataFrame, least: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"):
        counts = written(term_counts(docs, text_col, lang_col, source_col), "terms")
        terms = counts.filter("term IS NOT NULL").groupBy("lang", "term")
        kept = terms.agg(F.sum("uses").alias("lang_uses"), F.sum("docs").alias("lang_docs")).filter(F.col("lang_docs") >= least)
        uses = written(counts.filter("term IS NOT NULL").drop("docs").join(kept.drop("lang_docs"), ["lang", "term"]), "kept-terms")
        per_group = uses.groupBy("lang", "source").agg(F.sum("uses").alias("total"))
        per_lang = uses.groupBy("lang").agg(
            F.sum("uses").alias("lang_total"), F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("rows")
        )
        groups = counts.filter("term IS NULL").select("lang", "source").join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
        groups = groups.fillna(0, ["total", "lang_total", "terms", "rows"])
        self.groups = written(groups.withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))), "groups")
        self._few = bounded_broadcast(self.groups, FEW_GROUPS)
        self.uses = uses.join(self._few, ["lang", "source"]).withColumn("p", share(F.col("uses"), F.col("total"), F.col("terms")))

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the language), value: the divergence of source from item over all kept terms."""
        columns = ["lang", "source", "term", "uses", "p", "p0"]
        block = F.pmod(F.xxhash64("term"), F.ceil(F.col("rows") / BLOCK_ROWS))
        blocks = self.uses.withColumn("block", block).select("block", *columns).groupBy("lang", "block")
        joint = blocks.applyInArrow(_joint, "lang string, source string, item string, joint bigint")
        levels = self.uses.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
        others = bounded_broadcast(self.groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), FEW_GROUPS)
        single = levels.join(others, "lang").filter("source <> item")
        base = divergence(F.col("p0"), F.col("q0"))
        outward = single.select("lang", "source", "item", (F.col("n") * (divergence(F.col("p"), F.col("q0")) - base)).alias("part"))
        back = (F.col("n") * (divergence(F.col("q0"), F.col("p")) - divergence(F.col("q0"), F.col("p0")))).alias("part")
        inward = single.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), back)
        every = self.groups.join(others, "lang").filter("source <> item")
        whole = every.select("lang", "source", "item", F.coalesce(F.col("terms") * base, F.lit(0)).cast("bigint").alias("part"))
        parts = whole.unionByName(outward).unionByName(inward).unionByName(joint.withColumnRenamed("joint", "part"))
        return parts.groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))

    def terms(self) -> DataFrame:
        """lang, source, item (a kept term), value: terms that the source uses more than its language does."""
        q = share(F.col("lang_uses"), F.col("lang_total"), F.col("terms"))
        rows = self.uses.withColumn("q", q).filter("uses > 0 AND p > q")
        return rows.select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """Rows of a part with their rank in the group, up to ``most``."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    out = rows.withColumn("rank", F.row_number().over(order))
    out = out if most is None else out.filter(F.col("rank") <= most)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, least: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    own = Audit(docs, least)
    return ranked(own.pairs(), "pair").unionByName(ranked(own.terms(), "term", most_terms))
