"""Packing of examples into sequences by vector bin packing.

An example is a vector (tokens, 1 segment, loss-bearing tokens); a sequence has a
limit on each.  The dot-product heuristic fills one sequence at a time: of the
examples that still fit, it takes the one whose vector, with every dimension
weighted by its total demand, has the largest dot product with what is left.
Large examples that match the remaining capacity therefore go first and the
scarcest dimension decides.

Packing is local to a window of consecutive examples of one input partition, so
nothing is shuffled and memory is bounded by the window; what a window leaves
unfilled is carried into the next one.  Where examples may be cut, an example
longer than a sequence gives full sequences first, and a sequence that nothing
fits any more is filled by cutting the best example.  The last tokens of a
partition form sequences whose lengths are powers of two, which need no padding.

Defined cases: a null text is empty and has only its end id; rows that repeat an
id are packed separately; an example that can't be cut and is over a limit gets a
null sequence; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.chunks import ODD, ChunkTable, Merges
from tickerloom.llm.common import slices, spans, texts_of

WINDOW = 1024
BARE = "\x03"
_WORD = re.compile(r"(?= \S)")
_ODD = re.compile(r" (?:\s|$)")
# One space in front, single line ends, plain characters and no apostrophe: such a chunk falls into runs of letters, digits and signs.
_L = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
_SIGN = rf"[{_L}0-9!-&(-;=-@\[-`{{-~]+"
_PLAIN = re.compile(rf" ?{_SIGN}(?:\n{_SIGN})*\n?")
_PARTS = re.compile(rf" ?[{_L}]+| ?[0-9]+|\n| ?[^\n{_L}0-9 ]+")


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 512
    loss: int = 1024

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], np.int64)


def chunks(text: str) -> list[str]:
    """Pieces of a text that a byte-level pre-tokenizer never joins: cut at each space that other text
    follows.  A chunk stands for itself after a space; one without it is marked by ``BARE``."""
    if BARE in text:
        return [BARE + text]
    if _ODD.search(text):
        return [c[1:] if c[0] == " " else BARE + c for c in _WORD.split(text) if c]
    out = text.split(" ")
    if out[0]:
        out[0] = BARE + out[0]
        return out
    return out[1:]


def parts(chunk: str) -> list[str]:
    """What the pre-tokenizer makes of a plain chunk; any other chunk is left whole and marked."""
    if chunk.isascii() and chunk.isalpha():
        return [" " + chunk]
    chunk = chunk[1:] if chunk[:1] == BARE else " " + chunk
    if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
        return _PARTS.findall(chunk)
    return [ODD + chunk]


_TABLES: dict[str, ChunkTable] = {}


def _table(path: str) -> ChunkTable:
    if path not in _TABLES:
        inner = ChunkTable(Merges(path).encode, 400_000)
        _TABLES[path] = ChunkTable(lambda fresh: inner.documents(parts, fresh))
    return _TABLES[path]


def tokenized(texts: list[str], path: str, end_id: int) -> list[np.ndarray]:
    """Ids of every text with the end id."""
    flat, lengths = _table(path).documents(chunks, texts)
    end = np.array([end_id], np.uint32)
    return [np.concatenate([flat[a:b], end]) for a, b in zip(*spans(lengths))]


class Bins:
    """The open sequence of one task, and its counter of sequences.

    ``pack`` reports (example, start, length, sequence, offset).  An example's
    first tokens are its prompt and bear no loss, its last ``loss`` tokens do.
    """

    def __init__(self, limits: Limits, cut: bool, first: int):
        self.limits, self.cut, self.counter = limits.array(), cut, first
        self.new_sequence()

    def fresh(self) -> int:
        self.counter += 1
        return self.counter - 1

    def new_sequence(self) -> None:
        self.sequence, self.left, self.offset = self.fresh(), self.limits.copy(), 0

    def _room(self, need: np.ndarray, left: np.ndarray) -> int:
        """Most tokens of an example that ``left`` takes."""
        return int(min(left[0], need[0], need[0] - need[2] + left[2])) if left[1] else 0

    def _piece(self, need: np.ndarray, length: int) -> np.ndarray:
        return np.array([length, 1, max(0, length - int(need[0] - need[2]))])

    def pack(self, tokens: np.ndarray, loss: np.ndarray) -> Iterator[tuple[int, int, int, int | None, int]]:
        """Place one window of examples; the last sequence stays open."""
        limits, start = self.limits, np.zeros(len(tokens), np.int64)
        need = np.stack([tokens, np.ones_like(tokens), loss], axis=1).astype(np.int64)
        alive = np.ones(len(tokens), bool)
        for e in np.flatnonzero((need > limits).any(axis=1)):
            if not self.cut:
                alive[e] = False
                yield int(e), 0, int(tokens[e]), None, 0
            while self.cut and (need[e] > limits).any():  # sequences of its own
                piece = self._piece(need[e], self._room(need[e], limits))
                yield int(e), int(start[e]), int(piece[0]), self.fresh(), 0
                start[e] += piece[0]
                need[e] -= piece - [0, 1, 0]
        demand = need[alive].sum(axis=0) / limits**2 if alive.any() else np.ones(3)
        value = need * demand
        while alive.any():
            score = np.where(alive, value @ self.left, -1.0)
            whole = np.where((need <= self.left).all(axis=1), score, -1.0)
            best = int(np.argmax(whole))
            piece = need[best].copy()
            if whole[best] < 0:  # nothing fits any more
                best = int(np.argmax(score))
                piece = self._piece(need[best], self._room(need[best], self.left) if self.cut else 0)
                if not piece[0]:
                    self.new_sequence()
                    continue
            yield best, int(start[best]), int(piece[0]), self.sequence, self.offset
            self.left -= piece
            self.offset += int(piece[0])
            start[best] += piece[0]
            need[best] -= piece - [0, 1, 0]
            value[best] = need[best] * demand
            alive[best] = need[best][0] > 0
            if not self.left[0]:
                self.new_sequence()


def even_ends(lengths: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """Deal the pieces of an unfilled sequence to sequences whose lengths are powers of two.

    Gives (piece, start in the piece, length, number of the new sequence, offset).
    """
    total = sum(lengths)
    room = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    sequence = offset = 0
    for piece, length in enumerate(lengths):
        start = 0
        while start < length:
            take = min(length - start, room[sequence] - offset)
            yield piece, start, take, sequence, offset
            start, offset = start + take, offset + take
            if offset == room[sequence]:
                sequence, offset = sequence + 1, 0


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int = 0,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids): one row per piece of a document.

    Every token bears loss, documents may be cut anywhere.  A sequence id is the
    input partition's number times 2^33 plus a counter, so it is unique and the
    same when a task runs again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(limits, True, TaskContext.get().partitionId() << 33)
        held: list[tuple] = []  # pieces of the open sequence: id, ids, start, tokens of the document, sequence, offset
        for part in slices(batches, limit=2 << 20):
            names, ids = part.column(0).to_pylist(), tokenized(texts_of(part), tokenizer_file, end_id)
            for a in range(0, len(ids), window):
                lengths = np.array([len(x) for x in ids[a : a + window]], np.int64)
                for e, start, length, sequence, offset in bins.pack(lengths, lengths):
                    own = ids[a + e]
                    held.append((names[a + e], own[start : start + length].copy(), start, len(own), sequence, offset))
            done = [r for r in held if r[4] != bins.sequence]
            held = [r for r in held if r[4] == bins.sequence]
            if done:
                yield table(closed(done, bins))
        if held:
            yield table(closed(held, bins))

    def closed(rows: list[tuple], bins: Bins) -> list[tuple]:
        """Rows of whole sequences; one that is neither full nor a power of two long is dealt anew."""
        filled: dict[int, int] = {}
        for r in rows:
            filled[r[4]] = filled.get(r[4], 0) + len(r[1])
        odd = {q for q, n in filled.items() if n != limits.tokens and n & (n - 1)}
        out = [r for r in rows if r[4] not in odd]
        for q in odd:
            own = [r for r in rows if r[4] == q]
            new: dict[int, int] = {}
            for k, start, length, sequence, offset in even_ends([len(r[1]) for r in own]):
                name, ids, at, tokens, _, _ = own[k]
                number = new.setdefault(sequence, 0) or bins.fresh()
                new[sequence] = number
                out.append((name, ids[start : start + length], at + start, tokens, number, offset))
        return out

    def table(rows: list[tuple]) -> pa.RecordBatch:
        raw = [r[1].astype("<u4").tobytes() for r in rows]
        whole = [[r[2] for r in rows], [len(r[1]) for r in rows], list(map(zlib.crc32, raw)), *([r[k] for r in rows] for k in (3, 4, 5))]
        data = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array(x, pa.int64()) for x in whole)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            data.append(pa.array(raw, pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(data, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids,
    )


def pack_examples(examples: DataFrame, limits: Limits, id_col: str = "id", tokens_col: str = "tokens", loss_col: str = "loss", window: int = WINDOW) -> DataFrame:
    """id, tokens, loss, sequence_id, offset for instruction examples, which are never cut.

    ``tokens`` and ``loss`` (loss-bearing tokens, at the end of the example) are
    given as columns; null counts as 0.  An example over a limit has a null sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(limits, False, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for a in range(0, batch.num_rows, window):
                part = batch.slice(a, window)
                tokens, loss = (part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                placed = sorted(bins.pack(tokens, loss))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([p[3] for p in placed], pa.int64()), pa.array([p[4] for p in placed], pa.int64())],
                    ["id", "tokens", "loss", "sequence_id", "offset"],
                )

    count = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0))
    rows = examples.select(F.col(id_col).alias("id"), count(tokens_col).alias("tokens"), F.least(count(loss_col), count(tokens_col)).alias("loss"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, tokens bigint, loss bigint, sequence_id bigint, offset bigint")
