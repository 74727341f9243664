import re
from collections import Counter, defaultdict

import pytest

from tickerloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def by_hand(rows, least=3, most=200):
    """All rows of the audit, term by term."""
    uses, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        uses[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in {g[0] for g in uses}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = {s: u for (k, s), u in uses.items() if k == lang}
        whole = sum(groups.values(), Counter())

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return [1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept]

        p, q = {s: shares(u) for s, u in groups.items()}, shares(whole)
        for s, u in groups.items():
            pairs = [(-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o.encode()) for o in groups if o != s]
            terms = [(-((a - b) ** 2 // b), t.encode()) for t, a, b in zip(kept, p[s], q) if u[t] and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)}
    return out


def check(df, **options):
    own = [tuple(r) for r in divergence.audit(df, **options).collect()]
    expected = by_hand([(r.text, r.lang, r.source) for r in df.collect()])
    assert len(own) == len(expected) and set(own) == expected


def test_odd_rows(spark, odd, empty):
    from pyspark.sql import functions as F

    sources = odd.withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3)))
    check(sources)
    check(sources.unionByName(sources).withColumns({c: F.lit(1) for c in ("term", "uses", "p", "item", "block", "rows", "n")}))
    assert divergence.audit(empty.withColumn("source", F.lit("x"))).count() == 0


@pytest.mark.parametrize("rows", [200_000, 40])
def test_documents(monkeypatch, documents, rows):
    monkeypatch.setattr(divergence, "BLOCK_ROWS", rows)
    check(documents)


def test_languages_without_kept_terms(spark):
    rows = [("a b", "x", "s"), ("c", "x", "t"), (None, "x", "u"), ("zz 12", "y", "s"), ("zz", "y", "s"), ("ZZ _", "y", ""), ("", "y", None), ("é É", "z", "only")]
    check(spark.createDataFrame(rows, "text string, lang string, source string"))


def test_pieces_cut_no_term(monkeypatch):
    text = ("Ab c1d é_" * 3000 + "w" * 9000 + " end").encode()
    whole = text.translate(divergence._LETTERS).split()
    monkeypatch.setattr(divergence, "PIECE_BYTES", 11)
    assert [t for piece in divergence._pieces(text) for t in piece.split()] == whole


def test_small_cells_give_the_same_sums(monkeypatch):
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(1)
    rows = [("en", f"s{s}", f"t{t}", int(n)) for s in range(7) for t in range(300) if (n := draw.zipf(1.5) % 50)]
    total = Counter()
    for _, s, _, n in rows:
        total[s] += n
    table = pa.table(
        {
            "lang": [r[0] for r in rows],
            "source": [r[1] for r in rows],
            "term": [r[2] for r in rows],
            "uses": [r[3] for r in rows],
            "p": [1 + 10**9 * (r[3] + 1) // (total[r[1]] + 300) for r in rows],
            "p0": [1 + 10**9 // (total[r[1]] + 300) for r in rows],
        }
    )
    large = sorted(divergence._joint(table).to_pylist(), key=str)
    monkeypatch.setattr(divergence, "CELLS", 5)
    assert sorted(divergence._joint(table).to_pylist(), key=str) == large and large
