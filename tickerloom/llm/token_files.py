"""Token ids in seekable zstandard files.

A file is a plain concatenation of zstandard frames, one frame per document, then
two skippable frames that any zstandard reader steps over:

* an id table: for each frame the document id (signed 64-bit) and its number of ids;
* a seek table in the published seekable format: for each frame its compressed
  size, decompressed size and checksum (low 32 bits of the XXH64 of the
  decompressed bytes), then the number of frames, a flag byte and a closing magic
  number.

A reader takes the two tables from the end of the file, then decompresses only the
frames of the documents it wants and checks each one.  Ids are little-endian
unsigned 32-bit integers.

Files hold consecutive ranges of ids, so file order and order in a file is the
order of ids.  A task writes under a name of its own attempt and renames when the
file is whole, so a lost or repeated task leaves no torn file.

Defined cases: a null text is empty and has only the end id; a null document id
comes first and reads back as null; rows that repeat an id follow one another; an
empty table gives no file.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.chunks import ODD, ChunkTable, Encoded, Merges, joined
from tickerloom.llm.common import shared_path, slices, spans, store, texts_of
from tickerloom.plans.storage import settle

# Fixed values of the published seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
# The id table uses another of the sixteen skippable magic numbers.
ID_TABLE_MAGIC = 0x184D2A5D
NO_ID = -(1 << 63)
FILE_BYTES = 64 << 20


# Characters that normalization only lower-cases, and no apostrophe: such a chunk falls into letters, single digits and signs.
_PLAIN = re.compile(r"[A-Za-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF!-&(-;=-@\[-`{-~]*")
_PARTS = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")


def chunks(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def parts(chunk: str) -> list[str]:
    """What the pre-tokenizer makes of a plain chunk; any other chunk is left whole and marked."""
    if chunk.isascii() and chunk.isalpha():
        return [chunk.lower()]
    if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
        return _PARTS.findall(chunk.lower())
    return [ODD + chunk]


class Tokenizer:
    """A tokenizers file applied to chunks between white space, each distinct chunk once.

    The file's normalizer lower-cases and its pre-tokenizer drops white space and
    keeps runs of letters, digits and runs of signs apart, so the ids of a text are
    those of its chunks' parts, one after the other.  ``splits`` says whether that
    holds on a probe; if not, texts are encoded whole.
    """

    def __init__(self, path: str):
        self._merges = Merges(path)
        probe = "It's a  b\n c,d \u00e9\u00c9x 12. <|a|> " + " ".join(self._merges.special)
        flat, _ = self._merges.encode([p for c in chunks(probe) for p in parts(c)])
        self.splits = self._merges.lists([probe])[0] == flat.tolist()
        inner = ChunkTable(self._merges.encode, 400_000)
        self._table = ChunkTable(lambda fresh: inner.documents(parts, fresh))

    def encode(self, texts: list[str]) -> Encoded:
        """All ids in order, and the number of ids of each text."""
        return self._table.documents(chunks, texts) if self.splits else joined(self._merges.lists(texts))


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def frames(docs: DataFrame, tokenizer_file: str, end_id: int, edges: list[int], id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """doc_id, n_tokens, checksum, frame, file: one compressed frame per document; file k holds ids up to edge k."""
    bounds = np.array(edges, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = tokenizer(tokenizer_file), np.array([end_id], "<u4")
        pack = zstandard.ZstdCompressor(level=level, write_checksum=False)
        for part in slices(batches):
            flat, lengths = own.encode(texts_of(part))
            starts, stops = spans(lengths)
            ids = pc.fill_null(part.column(0), NO_ID).to_numpy()
            raw = [np.concatenate([flat[a:b].astype("<u4"), end]).tobytes() for a, b in zip(starts, stops)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(lengths + 1, pa.int64()),
                    pa.array([xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in raw], pa.int64()),
                    pa.array([pack.compress(x) for x in raw], pa.binary()),
                    pa.array(np.searchsorted(bounds, ids), pa.int32()),
                ],
                ["doc_id", "n_tokens", "checksum", "frame", "file"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, checksum bigint, frame binary, file int")


class Writer:
    """One seekable file; ``close`` writes the tables and gives the file its final name."""

    def __init__(self, folder: str, file: int):
        self._fs, self._folder = store(folder)
        self._name = f"{self._folder}/part-{file:08d}.zst"
        self._temp = f"{self._folder}/.{file}-{uuid.uuid4().hex}"
        self._out = self._fs.open_output_stream(self._temp)
        self._ids, self._tokens, self._sizes, self._checks = [], [], [], []

    def add(self, doc_id: int | None, n_tokens: int, checksum: int, frame: bytes) -> None:
        self._out.write(frame)
        self._ids.append(NO_ID if doc_id is None else doc_id)
        self._tokens.append(n_tokens)
        self._sizes.append(len(frame))
        self._checks.append(checksum)

    def close(self) -> tuple[int, int]:
        ids = np.empty(len(self._ids), [("id", "<i8"), ("n", "<i8")])
        ids["id"], ids["n"] = self._ids, self._tokens
        seek = np.empty(len(self._ids), [("size", "<u4"), ("raw", "<u4"), ("check", "<u4")])
        seek["size"], seek["raw"], seek["check"] = self._sizes, 4 * np.array(self._tokens), self._checks
        self._out.write(struct.pack("<II", ID_TABLE_MAGIC, ids.nbytes) + ids.tobytes())
        self._out.write(struct.pack("<II", SKIPPABLE_MAGIC, seek.nbytes + 9) + seek.tobytes())
        self._out.write(struct.pack("<IBI", len(ids), CHECKSUM_FLAG, SEEKABLE_MAGIC))
        self._out.close()
        self._fs.move(self._temp, self._name)
        return len(ids), int(ids["n"].sum())


class Reader:
    """Random access to one file: tables first, then single frames."""

    def __init__(self, folder: str, file: int):
        self._fs, path = store(folder)
        self._in = self._fs.open_input_file(f"{path}/part-{file:08d}.zst")
        size = self._in.size()
        self._in.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", self._in.read(9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a seekable file with checksums")
        at = size - 9 - 12 * count
        self._in.seek(at)
        self.seek = np.frombuffer(self._in.read(12 * count), [("size", "<u4"), ("raw", "<u4"), ("check", "<u4")])
        self._in.seek(at - 8 - 16 * count)
        table = np.frombuffer(self._in.read(16 * count), [("id", "<i8"), ("n", "<i8")])
        self.ids, self.tokens = table["id"], table["n"]
        self.starts = np.cumsum(self.seek["size"], dtype=np.int64) - self.seek["size"]
        self._unpack = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        """Ids of the k-th document as bytes, checked."""
        return self.frames(k, k + 1)[0]

    def frames(self, a: int, b: int) -> list[bytes]:
        """Ids of documents a to b - 1 with one read."""
        start = int(self.starts[a])
        self._in.seek(start)
        block = self._in.read(int(self.starts[b - 1]) + int(self.seek["size"][b - 1]) - start)
        out = []
        for k in range(a, b):
            at, size = int(self.starts[k]) - start, int(self.seek["size"][k])
            raw = self._unpack.decompress(block[at : at + size], max_output_size=int(self.seek["raw"][k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.seek["check"][k]):
                raise ValueError(f"checksum of frame {k} differs")
            out.append(raw)
        return out

    def blocks(self, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
        """Consecutive ranges of documents of about ``limit`` decompressed bytes."""
        ends, a = np.cumsum(self.seek["raw"], dtype=np.int64), 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
            yield a, b
            a = b

    def close(self) -> None:
        self._in.close()


def write(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the ids of all documents in ascending id order; file, documents, tokens, base, folder per file.

    Ranges of ids come from a quantile sketch of the ids alone.  Tokenizing and
    compressing happens before the one shuffle, which therefore carries
    compressed frames.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    shape = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit("")))), F.count(F.lit(1))).first()
    n_files = max(1, -(-int(shape[0] or 0) // file_bytes), -(-shape[1] // 500_000))
    cuts = [i / n_files for i in range(1, n_files)]
    edges = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), cuts, 10 * n_files)).first()[0] if cuts else []
    edges = sorted(set(edges or []))
    system, path = store(folder)
    system.create_dir(path, recursive=True)

    rows = frames(docs, tokenizer_file, end_id, edges, id_col, text_col)
    rows = rows.repartitionById(len(edges) + 1, F.col("file")).sortWithinPartitions("file", F.asc_nulls_first("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = None, None
        for batch in batches:
            ids, tokens, checks, data, files = (batch.column(k) for k in range(5))
            for k in range(batch.num_rows):
                if now != files[k].as_py():
                    if out:
                        yield summary(now, *out.close())
                    now = files[k].as_py()
                    out = Writer(folder, now)
                out.add(ids[k].as_py(), tokens[k].as_py(), checks[k].as_py(), data[k].as_py())
        if out:
            yield summary(now, *out.close())

    def summary(file: int, documents: int, tokens: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((file, pa.int32()), (documents, pa.int64()), (tokens, pa.int64()))], ["file", "documents", "tokens"])

    manifest = settle(rows.mapInArrow(run, "file int, documents bigint, tokens bigint"))
    done = sorted(manifest.collect())  # one row per file
    base, listed = 0, []
    for f, documents, tokens in done:
        listed.append((f, documents, tokens, base, folder))
        base += tokens
    return spark.createDataFrame(listed, "file int, documents bigint, tokens bigint, base bigint, folder string")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary) of every document in the files."""
    return _read(manifest, "ids binary", lambda raw: (raw, pa.binary()))


def checks(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    return _read(manifest, "ids_crc32 bigint", lambda raw: (zlib.crc32(raw), pa.int64()))


def _read(manifest: DataFrame, column: str, value) -> DataFrame:
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = Reader(row["folder"], row["file"])
                starts = row["base"] + np.cumsum(file.tokens) - file.tokens
                for a, b in file.blocks():
                    got = [value(raw) for raw in file.frames(a, b)]
                    ids = [None if i == NO_ID else int(i) for i in file.ids[a:b]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(starts[a:b]), pa.array(file.tokens[a:b]), pa.array([x for x, _ in got], got[0][1])],
                        ["doc_id", "start", "n_tokens", name],
                    )
                file.close()

    n = max(1, manifest.count())
    return manifest.repartitionById(n, F.col("file").cast("int") % n).mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {column}")


def read_documents(spark: SparkSession, manifest: DataFrame, wanted: list[int]) -> dict[int, np.ndarray]:
    """Ids of a few documents; only their frames are decompressed."""
    found = {}
    for row in manifest.collect():
        file = Reader(row["folder"], row["file"])
        for k in np.flatnonzero(np.isin(file.ids, wanted)):
            found[int(file.ids[k])] = np.frombuffer(file.frame(int(k)), "<u4")
        file.close()
    return found
