import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from tickerloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return bpe.codec(PATH)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def same(own, library, texts):
    ids = own.encode(texts)
    assert [i.tolist() for i in ids] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(i) for i in ids] == [library.decode(i.tolist(), skip_special_tokens=False) for i in ids]


def test_mixed_texts(own, library):
    draw = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", " \n", "\t", "'s", "'re", "don't", "é", " ", " ", "１", "12", "!", "<|endoftext|>", "<|endo"]
    parts += ["\U0001f600", "́", "՘", "\x1c", "\x85", "ab" * 40, "aaaa" * 80, "xyz" * 100, "\x00", "中文", "�"]
    same(own, library, ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(2000)])


def test_every_character(own, library):
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(own, library, ["".join(characters), " ".join(characters[::3]), "a".join(characters[::5])])


def test_long_words(own, library):
    draw = random.Random(2)
    texts = ["a" * n for n in (256, 257, 258, 1000, 4999)] + ["-" * n for n in range(240, 700, 13)]
    texts += ["".join(draw.choice("ab") for _ in range(draw.randrange(200, 3000))) for _ in range(20)]
    texts += ["".join("=" * draw.randrange(1, 300) + "-" * draw.randrange(1, 90) for _ in range(20)) for _ in range(20)]
    texts += ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000))]
    same(own, library, texts)


def test_lowest_nearby_equals_lowest_of_the_word(own):
    draw = np.random.default_rng(3)
    lengths = draw.integers(1, 60, 500)
    raw = draw.choice(np.frombuffer(b"aabeht -=", np.uint8), int(lengths.sum()))
    a, b = (own._merges.run(raw, lengths, long=k) for k in (False, True))
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_any_ids_decode_as_in_the_library(own, library):
    draw = np.random.default_rng(4)
    for _ in range(300):
        ids = draw.integers(0, 50257, draw.integers(0, 30)).astype(np.uint32)
        assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
    assert own.decode(np.array([60000], np.uint32)) == ""


def test_tables(odd, documents, empty, library):
    assert bpe.digest(empty, PATH).count() == 0
    for df in (odd, documents):
        expected = []
        for r in df.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            named = ",".join(map(str, ids))
            expected.append((r.doc_id, len(ids), hashlib.sha256(named.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert sorted(map(tuple, bpe.digest(df, PATH).collect()), key=str) == sorted(expected, key=str)


def test_round_trip(documents):
    back = bpe.decode(bpe.encode(documents, PATH), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text or "" for r in documents.collect()}


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "aba": 3}, ["ab a", "a b"])
