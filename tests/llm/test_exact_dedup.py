import hashlib
import re
from collections import defaultdict

from tickerloom.llm import exact_dedup as E


def brute(rows):
    groups = defaultdict(list)
    for at, (doc_id, text) in enumerate(rows):
        plain = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[hashlib.sha256(plain.encode()).hexdigest()].append((-len(text or ""), doc_id is None, doc_id or 0, at, doc_id))
    out = []
    for digest, found in groups.items():
        first = min(found)
        out += [(d, first[4], len(found), at == first[3], digest) for _, _, _, at, d in found]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_matches_brute_force(odd, documents):
    for df in (odd, documents):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        for support in (0.002, 0.05):
            assert got(E.exact_dedup(df, support=support)) == brute(rows)


def test_heavy_digests_are_split_off(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"own {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    heavy = E.heavy_winners(E.digests(df)).collect()
    assert [(h.group_size, h.best.doc_id) for h in heavy] == [(1000, 0)]
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in E.exact_dedup(df).collect())[:2] == [(0, 0, 1000), (1, 1, 1)]


def test_drop_copies_keeps_one_row_of_each_group(odd, documents, empty):
    assert E.drop_copies(empty).count() == 0 and E.exact_dedup(empty).count() == 0
    for df in (odd, documents):
        marked = E.exact_dedup(df).filter("kept").collect()
        stay = E.drop_copies(df)
        assert stay.columns == df.columns
        assert sorted(map(str, (r.doc_id for r in stay.collect()))) == sorted(map(str, (r.doc_id for r in marked)))


def test_no_python_in_the_plan(documents):
    plan = E.exact_dedup(documents)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
