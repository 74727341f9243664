"""Detection of periodic runs of words with extension queries on a recompression grammar.

A run is a stretch of words with smallest period q (words q apart are identical)
that is at least ``least`` words and ``times`` periods long and that no
neighbouring word extends with the same period.

1. The words of a slice of texts become integers in one flat array, with a letter
   of its own between texts, so that nothing below ever crosses from one text into
   the next.
2. Recompression turns the array into a run-length grammar: rounds of block
   compression (equal neighbours become one letter) alternate with rounds of pair
   compression (letters fall into two sides by a hash bit, each left-right pair
   becomes one letter), until hardly anything is left.  A round renames by sorting
   all blocks or pairs at once.
3. Equal stretches are compressed equally except at their borders.  So the longest
   common extension of two positions is found by climbing the rounds while the
   letters agree and stepping down where they differ, for all queries at once; to
   the left it is the same on the mirrored rounds.
4. A run with period q has its words equal to those q later on at least
   (times - 1) q positions, so it covers a point of the grid of that step.  All
   grid points of all periods are harmonically few; the points whose words agree
   are candidates, extended exactly to both sides.
5. A stretch found with several periods is kept with the smallest.

Defined cases: a null text is empty; a text without words has no runs and
collapses to the empty string; rows are independent, so repeated rows, ids and
null ids give equal rows; an empty table gives an empty result.  A very long text
is worked on alone, its words as integers (some hundred bytes a word), candidates
in blocks.  Only the id and text columns are read, whatever the names of the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickerloom.llm.common import picked, release, slices, spans

#: Bytes of text split into words at a time.
PIECE_BYTES = 1 << 20
#: Grid points looked at together.
BLOCK = 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


class Words:
    """Numbers of the distinct words of a slice; the words themselves are kept once."""

    def __init__(self):
        self._numbers: dict[bytes, int] = {}

    def numbers(self, text: bytes) -> np.ndarray:
        """Word numbers of a text; equal words have equal numbers, which say nothing else."""
        get, parts, start = self._numbers, [], 0
        while start < len(text):
            cut = _WHITE.search(text, start + PIECE_BYTES)
            stop = cut.end() if cut else len(text)
            words = text[start:stop].split()  # bytes split at exactly the six characters of the contract
            for w in set(words).difference(get):
                get[w] = len(get)
            parts.append(np.fromiter(map(get.__getitem__, words), np.int64, len(words)))
            start = stop
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def list(self) -> list[bytes]:
        return list(self._numbers)


@dataclass(frozen=True)
class Level:
    """One round: its letters, the first letter below that each came from, and the round's kind.

    ``below`` has one entry more than ``letters``.  In a block round a letter covers
    equal letters below, in a pair round one letter or two different ones.
    """

    letters: np.ndarray
    below: np.ndarray
    block: bool

    def mirrored(self) -> Level:
        return Level(self.letters[::-1].copy(), (self.below[-1] - self.below)[::-1].copy(), self.block)


def _renamed(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].reshape(-1)


def _blocks(letters: np.ndarray) -> Level:
    heads = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]]))
    below = np.append(heads, len(letters))
    lengths = np.diff(below)
    if len(heads) == len(letters):
        return Level(letters, below, True)
    return Level(_renamed(letters[heads] * (np.int64(lengths.max()) + 1) + lengths), below, True)


def _pairs(letters: np.ndarray, salt: int) -> Level:
    side = ((letters.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & np.uint64(1) == 1
    joins = side[:-1] & ~side[1:]
    other = ~side[:-1] & side[1:]
    if other.sum() > joins.sum():
        joins = other
    first = np.ones(len(letters), bool)
    first[1:] = ~joins
    heads = np.flatnonzero(first)
    paired = np.append(joins, False)[heads]
    size = np.int64(letters.max()) + 2
    second = np.where(paired, letters[np.minimum(heads + 1, len(letters) - 1)] + 1, 0)
    return Level(_renamed(letters[heads] * size + second), np.append(heads, len(letters)), False)


class Grammar:
    """Run-length grammar of an array whose first and last letters occur nowhere else."""

    def __init__(self, letters: np.ndarray):
        self._bottom = letters
        self._levels: list[Level] = []
        salt, still = 0, 0
        while len(letters) > 2 and still < 8:
            level = _pairs(letters, salt) if salt % 2 else _blocks(letters)
            still = still + 1 if len(level.letters) == len(letters) else 0
            if len(level.letters) < len(letters):
                self._levels.append(level)
            letters, salt = level.letters, salt + 1

    def mirrored(self) -> Grammar:
        out = object.__new__(Grammar)
        out._bottom, out._levels = self._bottom[::-1].copy(), [level.mirrored() for level in self._levels]
        return out

    def _letters(self, k: int) -> np.ndarray:
        return self._levels[k - 1].letters if k else self._bottom

    def extensions(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """How many letters agree from each pair of different positions on.

        ``at`` is a pair's place in the letters of its round; positions are places in
        round 0, so a result is the first place that differs, less the start.
        """
        i, j = first.copy(), second.copy()
        stopped = np.full(len(i), -1)  # the round in which a pair has met different letters
        live = np.arange(len(i))
        for k in range(len(self._levels) + 1):
            letters = self._letters(k)
            if k == len(self._levels):  # the top: step on letter by letter
                while len(live):
                    same = letters[i[live]] == letters[j[live]]
                    stopped[live[~same]] = k
                    live = live[same]
                    i[live] += 1
                    j[live] += 1
                break
            level = self._levels[k]
            a, b = i[live], j[live]
            same = letters[a] == letters[b]
            stopped[live[~same]] = k
            live, a, b = live[same], a[same], b[same]
            # the letters above that hold these two, and how much of them lies ahead
            up_a, up_b = (np.searchsorted(level.below, x, "right") - 1 for x in (a, b))
            inside = (level.below[up_a] != a) | (level.below[up_b] != b)
            ahead_a, ahead_b = level.below[up_a + 1] - a, level.below[up_b + 1] - b
            ends = inside & (ahead_a != ahead_b)  # one block is over, the other goes on
            step = np.minimum(ahead_a, ahead_b)
            i[live], j[live] = np.where(ends, a + step, up_a + inside), np.where(ends, b + step, up_b + inside)
            stopped[live[ends]] = k
            live = live[~ends]
        return self._descend(i, j, stopped) - first

    def _descend(self, i: np.ndarray, j: np.ndarray, stopped: np.ndarray) -> np.ndarray:
        """Places in round 0 of the first letters that differ, from pairs that differ in round ``stopped``."""
        for k in range(len(self._levels), 0, -1):
            level, letters = self._levels[k - 1], self._letters(k - 1)
            here = np.flatnonzero(stopped >= k)
            a, b = level.below[i[here]], level.below[j[here]]
            same = letters[a] == letters[b]
            n = np.minimum(level.below[i[here] + 1] - a, level.below[j[here] + 1] - b) if level.block else 1
            step = np.where(same, n, 0)
            i[here], j[here] = a + step, b + step
        return i


@dataclass(frozen=True)
class Found:
    """Runs, one entry each, ordered by text, start and period."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _grid(counts: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of all grid points, in blocks."""
    periods = counts // times
    text = np.repeat(np.arange(len(counts)), periods)
    period = picked(np.ones(len(counts), np.int64), periods)
    step = (times - 1) * period
    points = -((period - counts[text]) // step)  # places from 0 on whose partner is still in the text
    ends = np.cumsum(points)
    start = 0
    while start < len(text):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
        n = points[start:stop]
        owner = np.repeat(np.arange(start, stop), n)
        yield text[owner], picked(np.zeros(len(n), np.int64), n) * step[owner], period[owner]
        start = stop


def find(texts: list[np.ndarray], least: int = 6, times: int = 4) -> Found:
    """All runs of texts given as word numbers."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    kinds = 1 + max((int(t.max()) for t in texts if len(t)), default=0)
    starts, _ = spans(counts + 1)
    starts = starts + 1
    flat = np.empty(int(counts.sum()) + len(texts) + 1, np.int64)
    flat[0] = kinds
    for k, (at, words) in enumerate(zip(starts.tolist(), texts)):
        flat[at : at + len(words)] = words
        flat[at + len(words)] = kinds + 1 + k
    grammar = Grammar(flat)
    mirror = grammar.mirrored()
    found = [np.empty((0, 4), np.int64)]
    for text, place, period in _grid(counts, times):
        at = starts[text] + place
        same = flat[at] == flat[at + period]
        text, at, period = text[same], at[same], period[same]
        ahead = grammar.extensions(at, at + period)
        behind = mirror.extensions(len(flat) - at, len(flat) - at - period)
        length = ahead + behind + period
        enough = length >= np.maximum(least, times * period)
        rows = np.stack([text, at - behind - starts[text], length, period], axis=1)[enough]
        found.append(np.unique(rows, axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)  # the smallest period of each stretch
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return Found(*rows.T)


def remaining(counts: np.ndarray, found: Found) -> list[np.ndarray]:
    """Places of the words of each text that no run contains after its first period."""
    starts, ends = spans(counts + 1)
    change = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    np.add.at(change, starts[found.text] + found.start + found.period, 1)
    np.add.at(change, starts[found.text] + found.start + found.length, -1)
    free = np.cumsum(change) == 0
    return [np.flatnonzero(free[a : a + n]) for a, n in zip(starts.tolist(), counts.tolist())]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, runs (array of start, length and period in words, by start and period) and collapsed
    (the text's words without those that a run repeats, joined by one space)."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words()
            texts = [words.numbers(t.encode()) for t in part.column(1).fill_null("").to_pylist()]
            counts = np.fromiter(map(len, texts), np.int64, len(texts))
            found = find(texts, least, times)
            per_text = np.searchsorted(found.text, np.arange(len(texts) + 1)).astype(np.int32)
            structs = pa.StructArray.from_arrays([found.start, found.length, found.period], ["start", "length", "period"])
            known = words.list()
            collapsed = [b" ".join(map(known.__getitem__, t[keep].tolist())) for t, keep in zip(texts, remaining(counts, found))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(per_text, structs).cast(kind), pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["doc_id", "runs", "collapsed"],
            )
            release()

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    schema = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")
