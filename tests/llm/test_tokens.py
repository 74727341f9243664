import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from tickerloom.llm import packing, sentencepieces, token_files
from tickerloom.llm.chunks import ChunkTable, joined
from tickerloom.llm.common import shared_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_chunk_table_is_emptied_at_its_bound():
    table = ChunkTable(lambda cs: joined([[len(c)] * 2 for c in cs]), max_chunks=3)
    for _ in range(3):
        ids, lengths = table.encode(["a", "bb", "ccc", "a", "dddd"], 5)
        assert ids.tolist() == [1, 1, 2, 2, 3, 3, 1, 1, 4, 4] and lengths.tolist() == [2] * 5
    assert table.documents(str.split, ["", "a bb", ""])[1].tolist() == [0, 4, 0]


def test_sentencepiece_equals_the_library(odd, documents, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert sentencepieces.codec(PIECES).splits
    assert sentencepieces.digest(empty, PIECES).count() == 0
    for df in (odd, documents):
        expected = []
        for r in df.collect():
            ids = model.encode(r.text or "", add_bos=True, add_eos=True)
            raw, text = np.array(ids, "<u4").tobytes(), model.decode(ids)
            expected.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert sorted(map(tuple, sentencepieces.digest(df, PIECES).collect()), key=str) == sorted(expected, key=str)


def test_sentencepiece_round_trip_keeps_texts(documents):
    back = sentencepieces.encode(documents, PIECES, decode=True)
    assert {r.doc_id: r.decoded for r in back.collect()} == {r.doc_id: r.text or "" for r in documents.collect()}


@pytest.mark.parametrize("file_bytes", [64 << 20, 20_000])
def test_token_files_equal_the_library(odd, documents, empty, file_bytes):
    own = tokenizers.Tokenizer.from_file(WORDS)
    assert token_files.tokenizer(WORDS).splits
    assert token_files.checks(token_files.write(empty, WORDS, 1)).count() == 0
    for df in (odd, documents):
        expected, start = [], 0
        for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
            ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 1]
            expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        manifest = token_files.write(df, WORDS, 1, file_bytes=file_bytes)
        assert file_bytes > 1 << 20 or manifest.count() > 1
        assert sorted(map(tuple, token_files.checks(manifest).collect()), key=str) == sorted(expected, key=str)


def test_single_documents_are_read_and_checked(spark, documents):
    folder = shared_path(spark, "files")
    manifest = token_files.write(documents, WORDS, 1, folder)
    wanted = token_files.read_documents(spark, manifest, [5, 17])
    own = tokenizers.Tokenizer.from_file(WORDS)
    texts = {r.doc_id: r.text or "" for r in documents.filter("doc_id IN (5, 17)").collect()}
    assert {k: v.tolist() for k, v in wanted.items()} == {k: [*own.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    _, path = token_files.store(folder)
    with open(f"{path}/part-00000000.zst", "r+b") as f:
        f.seek(30)
        byte = f.read(1)
        f.seek(30)
        f.write(bytes([byte[0] ^ 1]))
    reader = token_files.Reader(folder, 0)
    with pytest.raises(Exception):
        reader.frame(0)
    assert reader.frame(1)


def check_packing(rows, ids_of, limit=1024):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    for doc_id, copies in ids_of.items():
        joined = sorted(pieces.pop(doc_id), key=lambda r: (r.start, r.length))
        assert sum(r.length for r in joined) == sum(map(len, copies))
        for ids in copies[:1]:
            raw = np.array(ids, "<u4")
            for r in joined:
                assert r.doc_tokens == len(ids) and zlib.crc32(raw[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert not pieces
    return padding


def test_packing_places_every_token_once(odd, documents, empty):
    own = tokenizers.Tokenizer.from_file(BYTES)
    assert packing.pack_documents(empty, BYTES).count() == 0
    for df in (odd, documents.repartition(3)):
        ids_of = {}
        for r in df.collect():
            ids_of.setdefault(r.doc_id, []).append([*own.encode(r.text or "", add_special_tokens=False).ids, 0])
        for limits in (packing.Limits(), packing.Limits(1024, 3, 1024), packing.Limits(1024, 64, 900)):
            rows = packing.pack_documents(df, BYTES, limits=limits, window=64).collect()
            assert check_packing(rows, ids_of) == 0
            counts = {}
            for r in rows:
                counts[r.sequence_id] = counts.get(r.sequence_id, 0) + 1
            assert max(counts.values()) <= limits.segments


def test_examples_stay_whole_within_all_limits(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(t), int(rng.integers(0, t + 1))) for i, t in enumerate(rng.integers(1, 700, 2000))] + [(5000, 2000, 3), (5001, None, None)]
    limits = packing.Limits(1024, 6, 700)
    out = packing.pack_examples(spark.createDataFrame(rows, "id int, tokens int, loss int").coalesce(1), limits).collect()
    assert len(out) == len(rows) and [r.id for r in out if r.sequence_id is None] == [5000]
    bins = {}
    for r in out:
        if r.sequence_id is not None:
            bins.setdefault(r.sequence_id, []).append(r)
    for found in bins.values():
        assert sum(r.tokens for r in found) <= 1024 and sum(r.loss for r in found) <= 700 and len(found) <= 6
        ends = sorted((r.offset, r.tokens) for r in found)
        assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    assert sum(r[1] or 0 for r in rows[:2000]) / 1024 / len(bins) > 0.93
