"""Distinct-chunk table: encode every distinct chunk once, join ids back by position."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Sequence
from itertools import chain

import numpy as np
import tiktoken
import tokenizers

from tickerloom.llm.common import picked

#: Marks a chunk that only the library itself may encode.
ODD = "\x02"
Encoded = tuple[np.ndarray, np.ndarray]  # ids of all chunks, and the number of ids of each


def joined(lists: Sequence[Sequence[int]]) -> Encoded:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for ids in lists for i in ids), np.uint32, int(lengths.sum())), lengths


class _Places(dict):
    """chunk -> place in the table; chunks asked for the first time get the next places and are listed in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = place = len(self)
        self.fresh.append(chunk)
        return place


class ChunkTable:
    """Ids of the distinct chunks seen so far.

    The table is emptied when it holds over ``max_chunks`` chunks or
    ``max_chars`` characters, so memory is bounded whatever the vocabulary.
    """

    def __init__(self, encode: Callable[[list[str]], Encoded], max_chunks: int = 250_000, max_chars: int = 16 << 20):
        self._encode, self._max_chunks, self._max_chars = encode, max_chunks, max_chars
        self._clear()

    def _clear(self) -> None:
        self._places = _Places()
        self._ids = np.empty(1 << 16, np.uint32)
        self._start = np.empty(1 << 16, np.int64)
        self._length = np.empty(1 << 16, np.int64)
        self._used = self._chars = 0

    def _add(self) -> None:
        """Encode the chunks asked for the first time."""
        chunks = self._places.fresh
        self._places.fresh = []
        flat, lengths = self._encode(chunks)
        known, need = len(self._places), self._used + len(flat)
        first = known - len(chunks)
        while len(self._ids) < need:
            self._ids = np.concatenate([self._ids, np.empty_like(self._ids)])
        while len(self._start) < known:
            self._start = np.concatenate([self._start, np.empty_like(self._start)])
            self._length = np.concatenate([self._length, np.empty_like(self._length)])
        self._ids[self._used : need] = flat
        self._start[first:known] = self._used + np.cumsum(lengths) - lengths
        self._length[first:known] = lengths
        self._used = need
        self._chars += sum(map(len, chunks))

    def encode(self, chunks: Iterable[str], count: int) -> Encoded:
        """All ids of the ``count`` chunks in order, and the number of ids of each chunk."""
        if len(self._places) > self._max_chunks or self._chars > self._max_chars:
            self._clear()
        at = np.fromiter(map(self._places.__getitem__, chunks), np.int64, count)
        if self._places.fresh:
            self._add()
        lengths = self._length[at]
        return self._ids[picked(self._start[at], lengths)], lengths

    def documents(self, split: Callable[[str], list[str]], texts: list[str]) -> Encoded:
        """Ids of all texts in order, and the number of ids of each text."""
        parts = list(map(split, texts))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(counts)
        ids, lengths = self.encode(chain.from_iterable(parts), int(ends[-1]) if len(ends) else 0)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[ends] - total[ends - counts]


def _byte_of() -> dict[str, int]:
    """Byte of each character of byte-level vocabularies: printable ones stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """Byte-pair merges of a tokenizers file.

    ``lists`` is the library itself.  ``encode`` gives the same ids for many short
    texts in few calls.  A text marked by a leading ``ODD`` goes through the
    library.  All others must be exactly one pre-token each, normalized and without
    control characters, and go through a faster engine for the same merges.
    """

    BORDER = "\x01"

    def __init__(self, path: str, together: int = 4000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._own, self._together = tokenizers.Tokenizer.from_file(path), together
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.special = [t.content for t in self._own.get_added_tokens_decoder().values()]
        suffix, border, byte = model.get("end_of_word_suffix") or "", self.BORDER.encode(), _byte_of()

        def raw(token: str) -> bytes:
            ended = bool(suffix) and token.endswith(suffix)
            return bytes(byte[c] for c in (token[: -len(suffix)] if ended else token)) + border * ended

        ranks = {bytes([b]): b for b in range(256)}
        if suffix:  # a last character with its word end is one symbol from the start
            for b in range(256):
                ranks.setdefault(bytes([b]) + border, len(ranks))
        for pair in model["merges"]:
            first, second = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(raw(first) + raw(second), len(ranks))
        self._ids = np.zeros(len(ranks), np.uint32)
        for token, i in model["vocab"].items():
            if token not in self.special:
                self._ids[ranks[raw(token)]] = i
        self._last = np.zeros(len(ranks), bool)
        for token, rank in ranks.items():
            self._last[rank] = token.endswith(border)
        self._suffix = bool(suffix)
        pattern = f"[^{self.BORDER}]*{self.BORDER}" if suffix else f"[^{self.BORDER}]+|{self.BORDER}"
        self._engine = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def lists(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._own.encode_batch_fast(texts, add_special_tokens=False)]

    def _fast(self, texts: list[str]) -> Encoded:
        ranks = np.array(self._engine.encode_ordinary(self.BORDER.join(texts) + self.BORDER), np.int64)
        ends = np.flatnonzero(self._last[ranks])
        lengths = np.diff(ends, prepend=-1)
        return (self._ids[ranks], lengths) if self._suffix else (self._ids[ranks[~self._last[ranks]]], lengths - 1)

    def encode(self, texts: list[str]) -> Encoded:
        plain = ~np.fromiter((t.startswith(ODD) for t in texts), bool, len(texts))
        fast = [t for t, p in zip(texts, plain) if p]
        parts = [self._fast(fast[a : a + self._together]) for a in range(0, len(fast), self._together)]
        parts.append(joined(self.lists([t[1:] for t, p in zip(texts, plain) if not p])))
        lengths = np.empty(len(texts), np.int64)
        lengths[plain] = np.concatenate([n for _, n in parts[:-1]]) if fast else 0
        lengths[~plain] = parts[-1][1]
        owner = np.repeat(plain, lengths)
        ids = np.empty(len(owner), np.uint32)
        ids[owner] = np.concatenate([i for i, _ in parts[:-1]]) if fast else 0
        ids[~owner] = parts[-1][0]
        return ids, lengths
