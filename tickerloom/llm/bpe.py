"""Byte-level BPE encoding and decoding by batched merge rounds in numpy.

A text is cut at added tokens, then by the pre-tokenizer's pattern into words.
Each distinct word is encoded once per worker (``ChunkTable``): the symbols of
many words lie in one flat array, and a round

1. looks up every adjacent pair by binary search over the sorted pair keys
   (left * size + right),
2. takes the lowest rank of each word, and
3. merges all its occurrences from left to right.

In a rank-ordered vocabulary a merge only creates pairs of higher rank, so this
is the same as merging one pair at a time.  Long words need many rounds if only
their lowest rank counts, so there a pair is merged when its rank is the lowest
within as many positions to each side as the longest token has bytes: a merge
from further away can't reach it first.  A run of overlapping equal pairs is
merged from its left end, and waits while that end has to wait.

Character classes are those of the tokenizers library: letters and digits that
its Unicode version does not know are read from its own pre-tokenizer.

Defined cases: a null text is empty; an empty text has no ids and decodes to the
empty string; invalid UTF-8 decodes with replacement characters and unknown ids
decode to nothing, as in the library.  Rows are independent: repeated rows (or
ids, or null ids) give equal rows, an empty table an empty result.  Very long
texts are held one at a time, with some 40 bytes for each byte of the longest
word.  Only the id and text columns are read, whatever the names of the others.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from tickerloom.llm.chunks import ChunkTable, Encoded
from tickerloom.llm.common import picked, slices, spans, texts_of

#: Words of more symbols are merged by the rule of the lowest rank nearby.
LONG = 256
BATCH_SYMBOLS = 1 << 20
_NONE = np.int32(2**31 - 1)
#: The published pattern of this kind of vocabulary, a fixed value.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CUT = regex.compile(r"(?= \S)")
_BLANKS = regex.compile(r" (?!\S)")


def bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printable = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def strangers(path: str) -> str:
    """Letters and digits of a newer Unicode version than the library's, which takes them for signs."""
    own, found = tokenizers.Tokenizer.from_file(path), []
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, before in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        members = regex.findall(kind, everything)
        probe = "\n".join(before + c for c in members)
        together = {probe[a:b] for _, (a, b) in own.pre_tokenizer.pre_tokenize_str(probe)}
        found += [c for c in members if before + c not in together]
    return "".join(found)


class Merges:
    """The merge table: sorted pair keys with the rank and the symbol that each pair makes.

    Symbols are token ids.
    """

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left, right, made = (np.array([vocab[t] for t in side], np.int64) for side in (*zip(*pairs), [a + b for a, b in pairs]))
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        born[made] = np.arange(len(pairs))
        if len(np.unique(made)) < len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError("merges must make each token once, and before it is used")
        self.size = np.int64(len(born))
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.ranks = np.append(order.astype(np.int32), _NONE)
        self.made = made.astype(np.int32)
        byte = bytes_of_characters()
        self.first = np.zeros(256, np.int32)
        for character, b in byte.items():
            self.first[b] = vocab[character]
        self.reach = max(map(len, vocab))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_NONE`` for pairs that never merge."""
        wanted = left * self.size + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)

    def _nearby(self, ranks: np.ndarray) -> np.ndarray:
        """Lowest rank within ``reach`` positions to each side."""
        padded = np.concatenate([np.full(self.reach, _NONE), ranks, np.full(self.reach, _NONE)])
        width, wanted = 1, 2 * self.reach + 1
        while width * 2 <= wanted:
            padded = np.minimum(padded[:-width], padded[width:])
            width *= 2
        return np.minimum(padded[: len(ranks)], padded[wanted - width : wanted - width + len(ranks)])

    def run(self, raw: np.ndarray, lengths: np.ndarray, long: bool = False) -> Encoded:
        """Ids of words given as their bytes, and the number of ids of each word; no word is empty."""
        out, counts = [], np.zeros(len(lengths), np.int64)
        symbols, words = self.first[raw], np.arange(len(lengths))
        ranks = np.full(len(symbols), _NONE, np.int32)
        starts, ends = spans(lengths)
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[ends - 1] = _NONE
        while len(words):
            lowest = np.minimum.reduceat(ranks, starts)
            live = lowest != _NONE
            if not live.all():
                keep = np.repeat(live, lengths)
                counts[words[~live]] = lengths[~live]
                out.append((words[~live], symbols[~keep]))
                symbols, ranks, words, lengths, lowest = symbols[keep], ranks[keep], words[live], lengths[live], lowest[live]
                starts, ends = spans(lengths)
                if not len(words):
                    break
            hit = (ranks == (self._nearby(ranks) if long else np.repeat(lowest, lengths))) & (ranks != _NONE)
            at = np.flatnonzero(hit)
            heads = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            runs = np.diff(np.append(heads, len(at)))
            head = at[heads]
            waits = (head > 0) & (ranks[head - 1] == ranks[head])  # the pair before is the same one and is not merged yet
            at = at[((at - np.repeat(head, runs)) % 2 == 0) & ~np.repeat(waits, runs)]
            symbols[at] = self.made[ranks[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            lengths = lengths - np.add.reduceat(~stay, starts, dtype=np.int64)
            starts, ends = spans(lengths)
            symbols, ranks = symbols[stay], ranks[stay]
            at = at - np.arange(len(at))
            new = np.unique(np.concatenate([at, at[at > 0] - 1]))
            ranks[new] = self.rank(symbols[new], symbols[np.minimum(new + 1, len(symbols) - 1)])
            ranks[ends - 1] = _NONE
        return self._ordered(out, counts)

    @staticmethod
    def _ordered(parts: list[Encoded], counts: np.ndarray) -> Encoded:
        """Ids of words that were finished in any order, in the order of the words."""
        starts, ends = spans(counts)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        for words, symbols in parts:
            n = counts[words]
            first, _ = spans(n)
            ids[np.repeat(starts[words] - first, n) + np.arange(len(symbols))] = symbols
        return ids, counts


class Codec:
    """Encoder and decoder of one tokenizers file; ``odd`` as ``strangers`` gives it."""

    def __init__(self, path: str, odd: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added, model, before = file["added_tokens"], file["model"], file["pre_tokenizer"] or {}
        if file["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level vocabularies with the usual pattern are supported")
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take part of their surroundings are not supported")
        self._added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self._added, key=len, reverse=True)
        self._special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self._merges = Merges(model["vocab"], model["merges"])
        self._as_sign = dict.fromkeys(map(ord, odd), "\u2603")
        self._words = ChunkTable(self._merge)
        self._chunks = ChunkTable(lambda chunks: self._words.documents(self._cut, chunks))
        self._token_bytes, self._token_lengths = self._spelled(model["vocab"])

    def _spelled(self, vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """A row of bytes for each id, and its length; ids without a token have none."""
        byte = bytes_of_characters()
        spelled = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
        for t, i in self._added.items():
            spelled[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.names = {i: str(i) for i in spelled}
        lengths = np.zeros(max(spelled) + 1, np.int64)
        for i, raw in spelled.items():
            lengths[i] = len(raw)
        starts, ends = spans(lengths)
        flat = np.zeros(int(ends[-1]), np.uint8)
        for i, raw in spelled.items():
            flat[starts[i] : ends[i]] = np.frombuffer(raw, np.uint8)
        self._token_starts = starts
        return flat, lengths

    def split(self, text: str) -> list[str]:
        """Pieces that the pre-tokenizer never joins: added tokens, and the text between them cut at
        each space that other text follows."""
        if self._special and self._special.search(text):
            return [c for part in self._special.split(text) if part for c in ([part] if part in self._added else self._plain(part))]
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if _BLANKS.search(text):
            return [c for c in _CUT.split(text) if c]
        first, *rest = text.split(" ")
        rest = [" " + c for c in rest]
        return [first, *rest] if first else rest

    def _cut(self, chunk: str) -> list[str]:
        """Words of a chunk by the pre-tokenizer's pattern."""
        if chunk in self._added:
            return [chunk]
        if chunk.isascii() or (seen := chunk.translate(self._as_sign)) == chunk:
            return _WORD.findall(chunk)
        return [chunk[m.start() : m.end()] for m in _WORD.finditer(seen)]

    def _merge(self, words: list[str]) -> Encoded:
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        kind = np.where(lengths > LONG, 1, 0)
        if self._added:
            kind[[i for i, w in enumerate(words) if w in self._added]] = 2
        parts, counts = [], np.ones(len(words), np.int64)
        for k in (0, 1):
            mine = np.flatnonzero(kind == k)
            groups = np.cumsum(lengths[mine]) // BATCH_SYMBOLS
            for at in np.split(mine, np.flatnonzero(np.diff(groups)) + 1) if len(mine) else []:
                symbols, n = self._merges.run(np.frombuffer(b"".join(raw[i] for i in at), np.uint8), lengths[at], long=bool(k))
                counts[at] = n
                parts.append((at, symbols))
        special = np.flatnonzero(kind == 2)
        parts.append((special, np.array([self._added[words[i]] for i in special], np.uint32)))
        return Merges._ordered(parts, counts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, lengths = self._chunks.documents(self.split, texts)
        return [ids[a:b] for a, b in zip(*spans(lengths))]

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[ids < len(self._token_lengths)]
        return self._token_bytes[picked(self._token_starts[ids], self._token_lengths[ids])].tobytes().decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}
_STRANGERS: dict[str, str] = {}


def codec(path: str, odd: str | None = None) -> Codec:
    """One codec per worker and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path, odd if odd is not None else strangers(path))
    return _CODECS[path]


def _mapped(docs: DataFrame, path: str, id_col: str, value_col: str, columns: str, row) -> DataFrame:
    """One row per row of ``docs``: its id as doc_id, then what ``row`` makes of the codec and a slice."""
    if path not in _STRANGERS:
        _STRANGERS[path] = strangers(path)
    odd = _STRANGERS[path]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, odd)
        for part in slices(batches, "value"):
            yield pa.RecordBatch.from_arrays([part.column(0), *row(own, part)], names)

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{value_col}` AS value")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {columns}"
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]
    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit)."""

    def row(own: Codec, part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([i.astype("<u4").tobytes() for i in own.encode(texts_of(part, "value"))], pa.binary())]

    return _mapped(docs, path, id_col, text_col, "ids binary", row)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: of ids as ``encode`` writes them; null ids give the empty text."""

    def row(own: Codec, part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([own.decode(np.frombuffer(i or b"", "<u4")) for i in part.column(1).to_pylist()], pa.string())]

    return _mapped(rows, path, id_col, ids_col, "text string", row)


def ids_digest(own: Codec, ids: np.ndarray) -> str:
    """SHA-256 of the decimal ids joined by commas, taken in pieces."""
    digest = hashlib.sha256()
    for a in range(0, len(ids), 1 << 16):
        digest.update(("," * (a > 0) + ",".join(map(own.names.__getitem__, ids[a : a + (1 << 16)].tolist()))).encode())
    return digest.hexdigest()


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding with only their digests carried on."""

    def row(own: Codec, part: pa.RecordBatch) -> list[pa.Array]:
        ids = own.encode(texts_of(part, "value"))
        return [
            pa.array([len(i) for i in ids], pa.int64()),
            pa.array([ids_digest(own, i) for i in ids], pa.string()),
            pa.array([hashlib.sha256(own.decode(i).encode()).hexdigest() for i in ids], pa.string()),
        ]

    return _mapped(docs, path, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", row)
