"""Correlations and availability against plain computations."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tickerloom.functions.stats import correlation
from tickerloom.operators import audits as au
from tickerloom.plans import blocks as bl


def table(spark, rows=400):
    rng = random.Random(3)
    out = []
    for i in range(rows):
        a = rng.gauss(1e6, 1)
        b = a + rng.gauss(0, 0.5)
        out.append((a, b if rng.random() > 0.3 else None, 7.0, None, rng.random() if i % 2 else float("nan"), 0.1 if i % 3 else None, i))
    return spark.createDataFrame(out, "a double, b double, constant double, nothing double, c double, thirds double, k int").repartition(6)


def test_correlations_over_complete_pairs(spark, monkeypatch):
    df = table(spark)
    columns = df.columns
    clean = df.withColumn("c", F.nanvl("c", F.lit(None).cast("double")))
    for branches in (bl.BRANCHES, 2):
        monkeypatch.setattr(bl, "BRANCHES", branches)
        own = {(r.feature_1, r.feature_2): r.abs_correlation for r in au.correlation_pairs(df, columns).collect()}
        for i, x in enumerate(columns):
            for y in columns[i + 1 :]:
                expected = clean.agg(F.abs(correlation(F.col(x).cast("double"), F.col(y).cast("double")))).first()[0]
                if expected is None or math.isnan(expected):
                    assert (x, y) not in own
                else:
                    assert abs(own[x, y] - expected) < 1e-7
    assert np.isnan(au.correlation_matrix(df.limit(0), ["a", "b"])).all()


def test_many_columns_in_one_pass(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 150))
    df = spark.createDataFrame(x.tolist(), [f"v{i}" for i in range(150)])
    assert np.allclose(au.correlation_matrix(df, df.columns), np.corrcoef(x.T))


def test_redundant_equals_a_walk_over_sorted_pairs(spark):
    """Strongest pair first; the standing of a name decides who stays."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 3))
    names = ["fourier_cycle_clarity", "fourier_amp_1", "fourier_energy_concentration", "fourier_x", "fourier_freq_2", "fourier_period_3"]
    mix = np.array([[1, 0, 0], [1, 0.01, 0], [1, 0.02, 0.01], [0, 1, 0], [0, 1, 0.03], [0, 0, 1]])
    x = base @ mix.T
    df = spark.createDataFrame(x.tolist(), names)
    r = np.abs(np.corrcoef(x.T))

    def standing(n):
        part = n.startswith(("fourier_amp_", "fourier_freq_", "fourier_period_"))
        return (0 if n in au.DERIVED else 1 if n in au.RAW else 2 if part else 3, n)

    pairs = [(-r[i, j], *sorted((standing(names[i]), standing(names[j])))) for i in range(6) for j in range(i) if r[i, j] >= 0.98]
    leads = {n: [] for n in names}
    for c, keep, lose in sorted(pairs):
        if keep[1] in leads and lose[1] in leads:
            leads[keep[1]] += [(lose[1], -c), *leads.pop(lose[1])]
    expected = {(d, k): c for k, group in leads.items() for d, c in group}
    own = {(d, k): c for d, k, c in au.redundant(df, names)}
    assert own.keys() == expected.keys() and len(own) >= 3
    assert all(abs(own[k] - expected[k]) < 1e-9 for k in own)


def test_first_available(spark):
    df = table(spark, 20)
    assert au.first_available(df, ("missing", "nothing", "b", "a"), ("nothing",), ()) == ["b", None, None]
    assert au.first_available(df, ("missing",)) == [None]
    assert au.first_available(df.limit(0), ("a",)) == [None]


def test_label_ranks_go_by_distinct_values(spark):
    rng = random.Random(8)
    data = [(f, float(rng.randrange(9)), float(rng.random() < 0.4) if rng.random() < 0.8 else None, 1.0 if f == "a" else None, i) for f in "ab" for i in range(300)]
    rows = spark.createDataFrame(data, "feature string, v double, up double, down double, i int").repartition(5)
    got = {r.feature: r for r in au._label_spearman(rows, ["up", "down"]).collect()}
    for f in "ab":
        known = [(v, u) for g, v, u, _, _ in data if g == f and u is not None]
        values = np.array([v for v, _ in known])
        ranks = np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])
        assert math.isclose(got[f].r_up, np.corrcoef(ranks, [u for _, u in known])[0, 1], rel_tol=1e-9)
        assert got[f].r_down is None
