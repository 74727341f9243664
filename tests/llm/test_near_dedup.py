import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import near_dedup as N


def brute(rows, words, percent):
    """component and set size by row."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    seen = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id in seen and doc_id is not None:
            root[find(i)] = find(seen[doc_id])
        seen.setdefault(doc_id, i)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        shared = {}
        for g in s:
            for j in holders[g]:
                if j < i and rows[j][0] is not None:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = None if doc_id is None else least[find(i)]
        out.append((doc_id, len(sets[i]), component, doc_id is None or component == doc_id))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, odd, words, percent):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (odd, documents):
        assert got(N.near_dedup(df, words, percent)) == brute([(r.doc_id, r.text) for r in df.collect()], words, percent)


def family(n, edits, seed=1, length=90):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(own)))
    return rows


def test_one_large_family_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_BYTES", 20_000)
    rows = family(600, 12)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(N.near_dedup(df, 3, 85)) == brute(rows, 3, 85)


def test_block_of_singletons_with_an_unlinked_pivot():
    """True links 0-2 and 1-2 only."""
    whole = np.arange(100, dtype=np.uint64)
    own = [whole[12:], whole[:-12], whole, whole + np.uint64(1000)]
    found = N.joining_links([10, 11, 12, 13], [10, 11, 12, 13], [0] * 4, own, 80)
    assert sorted(tuple(sorted(x)) for x in found) == [(10, 12), (11, 12)]


@pytest.mark.parametrize("across", [False, True])
def test_blocks_give_the_components_of_all_pairs(across):
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(2, 14)
        base = [rng.sample(range(60), 40) for _ in range(3)]
        own = [np.array(sorted({x if rng.random() < 0.96 else 100 + rng.randrange(900) for x in rng.choice(base)}), np.uint64) for _ in range(n)]
        half = [rng.randrange(2) if across else 0 for _ in range(n)]
        start = [rng.randrange(n) if rng.random() < 0.3 else i for i in range(n)]

        def parts(links, start=start, n=n):
            root = list(range(n))
            for x, y in [*enumerate(start), *links]:
                a, b = root[x], root[y]
                root = [b if r == a else r for r in root]
            return {frozenset(i for i in range(n) if root[i] == r) for r in root}

        least = {i: min(p) for p in parts([]) for i in p}
        split = len(set(half)) > 1
        near = [(x, y) for x in range(n) for y in range(x) if 100 * (k := len(set(own[x]) & set(own[y]))) >= 80 * (len(own[x]) + len(own[y]) - k) and not (split and half[x] == half[y])]
        found = N.joining_links(list(range(n)), [least[i] for i in range(n)], half, own, 80)
        assert parts(found) == parts(near)
        assert len(found) == len(parts([])) - len(parts(near))


def test_digest_depends_on_the_members_only(spark):
    rows = spark.range(50_000).selectExpr("id AS key", "explode(array(id, id + 7, id * 3 + 11)) AS id")
    turned = rows.selectExpr("key + 50000 AS key", "id").orderBy(F.desc("id"))
    digests = rows.unionByName(turned).groupBy("key").agg(*N.digest("id"))
    assert digests.count() == 100_000
    assert digests.select("who_1", "who_2").distinct().count() == 50_000


def test_estimate_is_close_to_the_truth():
    rng = np.random.default_rng(5)
    sketch = N.Sketch()
    m = sketch.multipliers()
    u, v, sizes, truth = [], [], [], []
    for _ in range(200):
        n, same = int(rng.integers(50, 2000)), rng.random()
        common = rng.integers(0, 1 << 63, int(n * same) + 1, np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, n - len(common) + 1 + extra, np.uint64)]) for extra in (0, n // 3))
        u.append(sketch.values(a, m))
        v.append(sketch.values(b, m))
        sizes.append((len(a), len(b)))
        truth.append(len(common) / (len(a) + len(b) - len(common)))
    sizes = np.array(sizes, float)
    error = sketch.estimate(np.array(u), np.array(v), sizes[:, 0], sizes[:, 1]) - np.array(truth)
    assert abs(error.mean()) < 0.01 and np.abs(error).max() < 5 * 0.5 / np.sqrt(sketch.registers)


def test_registers_merge():
    rng = np.random.default_rng(6)
    sketch = N.Sketch()
    m = sketch.multipliers()
    a, b = (rng.integers(0, 1 << 63, 500, np.uint64) for _ in range(2))
    assert (np.maximum(sketch.values(a, m), sketch.values(b, m)) == sketch.values(np.concatenate([a, b]), m)).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    assert {tuple(r) for r in N.components(edges).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}
    assert N.components(edges.filter("false")).count() == 0


def test_dropping_keeps_one_of_each_group(spark, odd, empty):
    assert N.drop_near_copies(empty).count() == 0
    kept = N.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IS NULL").count() == 1
    rows = family(50, 1, length=200)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("own"))
    assert [r.doc_id for r in N.drop_near_copies(df).collect()] == [1]
