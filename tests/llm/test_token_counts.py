import random

import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from tickerloom.llm import token_counts as T

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces, byte_fallback):
    own = Tokenizer(models.Unigram(pieces, 0, byte_fallback))
    own.pre_tokenizer = pre_tokenizers.Metaspace(replacement=T.MARK, prepend_scheme="always", split=True)
    return own


def test_counts_equal_the_tokenizer(odd, documents, empty):
    own = library(T.vocabulary(MODEL), True)
    assert T.count_tokens(empty, MODEL).count() == 0
    for df in (odd, documents):
        expected = [(r.doc_id, len(own.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect()]
        got = [(r.doc_id, r.n_tokens) for r in T.count_tokens(df, MODEL).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)


def test_ties_and_unknown_runs_follow_the_tokenizer():
    rng = random.Random(4)
    letters = "abcé"
    for byte_fallback in (False, True):
        for _ in range(60):
            made = {"".join(rng.choice(letters[:3]) for _ in range(rng.randint(1, 4))) for _ in range(6)} | {T.MARK}
            pieces = [("<unk>", -9.0), *((f"<0x{b:02X}>", -8.0) for b in range(256) if byte_fallback), *((p, -float(rng.randint(1, 3))) for p in sorted(made))]
            own, counter = library(pieces, byte_fallback), T.Counter(pieces, byte_fallback)
            for _ in range(20):
                text = "".join(rng.choice(letters + " ") for _ in range(rng.randint(0, 14)))
                assert counter.texts([text])[0][0] == len(own.encode(text).ids), (text, pieces)
