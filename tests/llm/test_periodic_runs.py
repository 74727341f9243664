import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tickerloom.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_scanning(words, least, times):
    """(start, length, period) of every run, by extending each period's equal words."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if s < i and i + q - s >= max(least, times * q):
                found.setdefault((s, i + q - s), q)
            i += s == i
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (6, 3), (1, 5)])
def test_runs_equal_a_scan(least, times):
    draw = random.Random(times)
    for _ in range(80):
        texts = []
        for _ in range(draw.randrange(8)):
            kinds = draw.choice([1, 2, 3, 5, 50])
            words = [draw.randrange(kinds) for _ in range(draw.randrange(60))]
            unit = [draw.randrange(kinds) for _ in range(draw.randrange(1, 12))]
            words += (unit * 9)[: draw.randrange(80)] + [draw.randrange(kinds) for _ in range(draw.randrange(9))]
            texts.append(np.array(words, np.int64))
        found = periodic_runs.find(texts, least, times)
        own = [[] for _ in texts]
        for text, *run in zip(found.text.tolist(), found.start.tolist(), found.length.tolist(), found.period.tolist()):
            own[text].append(tuple(run))
        expected = [by_scanning(t.tolist(), least, times) for t in texts]
        assert own == expected
        kept = periodic_runs.remaining(np.array([len(t) for t in texts], np.int64), found)
        assert [t[k].tolist() for t, k in zip(texts, kept)] == [collapsed(t.tolist(), e) for t, e in zip(texts, expected)]


def test_extensions_equal_comparison():
    draw = np.random.default_rng(5)
    for kinds in (1, 2, 4, 30):
        flat = np.concatenate([[100], np.tile(draw.integers(0, kinds, 40), 5), draw.integers(0, kinds, 300), [101]])
        i, j = draw.integers(0, len(flat) - 1, (2, 3000))
        i, j = i[i != j], j[i != j]
        own = periodic_runs.Grammar(flat).extensions(i, j)
        for a, b, n in zip(i.tolist(), j.tolist(), own.tolist()):
            m = len(flat) - max(a, b)
            differs = np.flatnonzero(flat[a : a + m] != flat[b : b + m])
            assert n == (differs[0] if len(differs) else m)


def test_grammar_is_small():
    grammar = periodic_runs.Grammar(np.concatenate([[1], np.zeros(1 << 16, np.int64), [2]]))
    assert sum(len(level.letters) for level in grammar._levels) < 100


def test_a_long_text_is_read_in_pieces(monkeypatch):
    text = ("ab\tcd\x0bé " * 2000 + "x" * 500 + " y").encode()
    whole = periodic_runs.Words().numbers(text)
    monkeypatch.setattr(periodic_runs, "PIECE_BYTES", 7)
    monkeypatch.setattr(periodic_runs, "BLOCK", 50)
    words = periodic_runs.Words()
    known = words.numbers(text)
    assert [words.list()[k] for k in known] == text.split()
    assert len(set(zip(known.tolist(), whole.tolist()))) == len(set(known.tolist())) == len(set(whole.tolist()))
    found = periodic_runs.find([whole])
    assert (found.start.tolist(), found.length.tolist(), found.period.tolist()) == ([0], [6000], [3])


def planted(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = by_scanning(words, 6, 4)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(collapsed(words, runs))
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept)))


def test_query(spark, tmp_path, odd, empty, monkeypatch):
    rows = [(k, " ".join(random.Random(k).choice("abcdefgh") for _ in range(k % 90)), "en") for k in range(20, 260)]
    table = odd.unionByName(spark.createDataFrame(rows, odd.select("doc_id", "text", "lang").schema), allowMissingColumns=True)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    own = queries.op11_periodic_runs(spark, str(tmp_path))
    assert own.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, own.collect()), key=str) == sorted((expected(r.doc_id, r.text) for r in table.collect()), key=str)
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_query_on_the_documents(spark, sf, documents):
    short = {r.doc_id: r.text for r in documents.collect() if len(r.text or "") < 4000}
    own = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert {k: own[k] for k in short} == {k: expected(k, t) for k, t in short.items()}
    assert any(v[1] for v in own.values())
