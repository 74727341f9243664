import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import lm
from tickerloom.llm.common import remainder
from tickerloom.llm.queries import QUERIES


def brute(rows):
    """Base scores by id from (id, text, held out)."""
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    counts = Counter(w for _, t, held in rows if not held for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, t, held in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        out.append((doc_id, held, len(own), sum(counts[w] > 0 for w in own), n, base))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent,filter_bytes", [(lm.FREQUENT_WORDS, lm.FILTER_BYTES), (200, 1000)])
def test_base_score_is_exact_with_and_without_rare_words(odd, documents, frequent, filter_bytes, monkeypatch):
    monkeypatch.setattr(lm, "TOKENS_PER_SHARD", 5000)
    for df in (documents, odd):
        df = df.select("doc_id", "text", (remainder("doc_id", 10) == 0).alias("held_out"))
        model = lm.fit(df.filter("NOT held_out"), frequent_words=frequent, filter_bytes=filter_bytes)
        if frequent == 200 and df.count() > 100:
            assert len(model.filters) > 2 and model.counts.count() > 1000
        got = sorted((tuple(r)[:6] for r in lm.score(df, model, ["doc_id", "held_out"]).collect()), key=str)
        expected = brute([tuple(r) for r in df.collect()])
        assert [g[:5] for g in got] == [e[:5] for e in expected]
        assert np.allclose([g[5] for g in got], [e[5] for e in expected])


def test_groups_of_shards_do_not_change_scores(documents, monkeypatch):
    monkeypatch.setattr(lm, "TOKENS_PER_SHARD", 5000)
    one, many = (
        {r.doc_id: r.score for r in lm.score(documents, lm.fit(documents, filter_bytes=size), ["doc_id"]).collect()} for size in (lm.FILTER_BYTES, 1000)
    )
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-6 for k in one)


def test_filter_holds_every_count_and_few_others():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 40_000, np.uint64)
    counts = np.random.default_rng(2).integers(1, 40, 20_000).astype(float)
    data = lm.filled(keys[:20_000], counts)
    held = lm.Filter(data, np.array([0]), np.array([8 * len(data)]))
    shard = np.zeros(20_000, np.int64)
    assert (np.log2(held.counts(keys[:20_000], shard) / counts) > -1).all()
    middle = held.counts(keys[:20_000], shard)
    assert (middle / counts < 1.6).mean() > 0.98
    assert (held.counts(keys[20_000:], shard) > 0).mean() < 0.02


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    out = QUERIES["op4_lm_score"](spark, "/root/testdata/sf0.01").filter("held_out")
    row = out.agg(F.sum("score"), F.sum("base_score"), F.max("score")).first()
    assert row[0] > row[1] and row[2] <= 0


def test_empty_tables(empty, documents):
    nothing = lm.fit(empty)
    assert lm.score(empty, nothing, ["doc_id"]).count() == 0
    out = lm.score(documents, nothing, ["doc_id"]).first()
    assert out.base_score == 0 and out.score == 0 and out.n_known == 0 and out.train_tokens == 0
