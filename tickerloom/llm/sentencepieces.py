"""SentencePiece encoding and decoding over a distinct-chunk table.

The library replaces spaces by the marker U+2581 and puts one before the text.
If no piece of the model has a marker after another character, no piece (and no
merge) crosses from a word into the next marker, so every marked word (markers,
then other characters) is segmented on its own.  Each distinct marked word is
segmented once and the ids are joined back by position.  A model with crossing
pieces is encoded text by text.

Defined cases: a null text is empty; an empty text has only the begin and end
ids; repeated rows and ids give equal rows; a very long text is one row; an empty
table gives an empty result.  Results never depend on other rows or columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tickerloom.llm.chunks import ChunkTable, Encoded, joined
from tickerloom.llm.common import slices, spans, texts_of

MARK = "▁"
_RUN = re.compile(r" +[^ ]*")


def words(text: str) -> list[str]:
    """Marked words with spaces for markers and without their first one; a lone marker is itself."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] or MARK for run in _RUN.findall(" " + text)]


class Codec:
    """Encoder and decoder for one model file."""

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = map(self.model.id_to_piece, range(self.model.vocab_size()))
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self._plain()
        self.ends = (self.model.bos_id(), self.model.eos_id())
        self._table = ChunkTable(self._encode)

    def _plain(self) -> bool:
        """The model keeps white space as it is and adds one marker in front."""
        return self.model.encode("a  b ", out_type=str)[0][:1] == MARK and self.model.decode(self.model.encode("a  b\t c ")) == "a  b\t c "

    def _encode(self, chunks: list[str]) -> Encoded:
        mark = self.model.piece_to_id(MARK)
        return joined([[mark] if c == MARK else ids for c, ids in zip(chunks, self.model.encode(chunks, num_threads=1))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Begin id, ids of the text, end id."""
        if not self.splits:
            return [np.array([self.ends[0], *ids, self.ends[1]], np.uint32) for ids in self.model.encode(texts, num_threads=1)]
        flat, lengths = self._table.documents(words, texts)
        begin, end = (np.array([i], np.uint32) for i in self.ends)
        starts, stops = spans(lengths)
        return [np.concatenate([begin, flat[a:b], end]) for a, b in zip(starts, stops)]

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


_CODECS: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """One codec per worker and model."""
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and, if asked for, decoded (string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for part in slices(batches):
            ids = own.encode(texts_of(part))
            columns = [part.column(0), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())]
            if decode:
                columns.append(pa.array([own.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary" + ", decoded string" * decode)


def digest(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode`` and ``decode`` with only their digests carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for part in slices(batches):
            ids = own.encode(texts_of(part))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(own.decode(i).encode()).hexdigest() for i in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
