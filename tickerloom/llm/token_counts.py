"""Token counts under a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton over the vocabulary finds every piece at every end of a
marked word.  Dynamic programming carries, for each place, the best score and the
number of pieces of the best path; of equal scores the path whose last piece
starts first stays, as in the tokenizer, whose search replaces a path only by a
strictly better one.  A character that no single-character piece covers is
unknown: it has the least score of the vocabulary minus 10 and counts as its UTF-8
bytes, or, without byte pieces, as one token for a run of them.

Words are cut at white-space markers as the tokenizer does before its search, so
each distinct word is counted once per worker and table.

Defined cases: a null text is empty and has no token; results depend on the text
alone, so repeated rows and ids give equal rows; a very long text is one row whose
matches are streamed; an empty table gives an empty result.  Columns other than id
and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tickerloom.llm.common import slices, texts_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the tokenizer


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces of a SentencePiece file with log probabilities that fall with the rank.

    The file's own scores are merge ranks, no probabilities; a piece at rank r gets
    -log(r + 1).
    """
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), -math.log(i + 1)) for i in range(model.vocab_size())]


def words(text: str) -> list[str]:
    """Marked words: every space is a marker that begins a word, and so does the text."""
    text = text.replace(" ", MARK)
    if not text:
        return []
    parts = text.split(MARK)
    return [MARK + p for p in (parts[1:] if text[0] == MARK else parts)]


class Counter:
    """Counts pieces of marked words for one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True, most: int = 400_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        held = {p for p, _ in pieces}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in held for b in range(256))
        self.known: dict[str, int] = {}
        self.most, self.chars = most, 0

    def count(self, word: str) -> int:
        """Number of tokens of the best path."""
        n, none = len(word), -math.inf
        best, pieces, unknown = [0.0] + [none] * n, [0] * (n + 1), [False] * (n + 1)
        end, top, start, lone = 1, none, 0, True  # of the place being decided

        def decide() -> None:
            if lone and best[end - 1] + self.unknown > top:
                best[end], unknown[end] = best[end - 1] + self.unknown, True
                more = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not unknown[end - 1])
                pieces[end] = pieces[end - 1] + more
            else:
                best[end], pieces[end] = top, pieces[start] + 1

        for last, (length, score) in self.automaton.iter(word):
            while end <= last:  # the matches of the places before are complete
                decide()
                end, top, start, lone = end + 1, none, 0, True
            s = end - length
            score += best[s]
            if score > top or score == top and s < start:
                top, start = score, s
            if length == 1:
                lone = False
        while end <= n:
            decide()
            end, top, start, lone = end + 1, none, 0, True
        return pieces[n]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and marked words of every text."""
        if len(self.known) > self.most or self.chars > 16 << 20:
            self.known, self.chars = {}, 0
        tokens, sizes = [], []
        for text in texts:
            own = words(text)
            counts = list(map(self.known.get, own))
            if None in counts:
                for w in {w for w, c in zip(own, counts) if c is None}:
                    self.known[w] = self.count(w)
                    self.chars += len(w)
                counts = map(self.known.__getitem__, own)
            tokens.append(sum(counts))
            sizes.append(len(own))
        return np.array(tokens, np.int64), np.array(sizes, np.int64)


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_words of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file not in _COUNTERS:
            _COUNTERS[model_file] = Counter(vocabulary(model_file))
        for part in slices(batches):
            tokens, sizes = _COUNTERS[model_file].texts(texts_of(part))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens), pa.array(sizes)], ["doc_id", "n_tokens", "n_words"])

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_words bigint")
