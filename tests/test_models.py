"""Fits against dense solutions and brute force."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import forests, linear
from tickerloom.operators import models as md
from tickerloom.plans import blocks as bl
from tickerloom.plans import selection

VALUES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(90):
        for ticker in "ABCDEFGH":
            a, b, c = rng.gauss(0, 1), rng.gauss(5, 3), float(rng.randrange(3))
            y = float(a + 0.3 * b - c + rng.gauss(0, 1) > 1)
            out.append((ticker, date(2020, 1, 1) + timedelta(i), a if rng.random() > 0.1 else None, b, c, 1e6 + rng.random(), y if rng.random() > 0.05 else None, float(a > 1)))
    return out


@pytest.fixture(scope="module")
def panel(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, a double, b double, c double, d double, y double, z double").repartition(5).cache()


@pytest.fixture(scope="module")
def table(panel):
    return bl.blocks(panel, VALUES, ["y", "z"])


def day(i):
    return (date(2020, 1, 1) - date(1970, 1, 1)).days + i


def dense(rows, start, end, label, columns=(2, 3, 4, 5)):
    own = [r for r in rows if day(start) <= day((r[1] - date(2020, 1, 1)).days) <= day(end) and r[label] is not None]
    return np.array([[np.nan if r[c] is None else r[c] for c in columns] for r in own]), np.array([r[label] for r in own])


@pytest.mark.parametrize("steps,few", [(256, 32), (100, 0)])
def test_quantiles_of_overlapping_windows(table, rows, monkeypatch, steps, few):
    monkeypatch.setattr(selection, "STEPS", steps)
    monkeypatch.setattr(selection, "FEW", few)
    places = [(0, 40, 6, 0), (20, 60, 6, 0), (20, 60, 7, 1), (85, 200, 6, 0), (300, 400, 6, 0)]
    windows = [selection.Window(day(a), day(b), label) for a, b, _, label in places]
    wanted = [0, 0.25, 0.5, 0.9, 1]
    own = selection.quantiles(table, windows, wanted)
    for k, (a, b, label, _) in enumerate(places):
        x, _ = dense(rows, a, b, label)
        for c in range(4):
            v = x[~np.isnan(x[:, c]), c] if len(x) else np.empty(0)
            if len(v):
                assert np.allclose(own[k, c], np.quantile(v, wanted), rtol=1e-14, atol=0)
            else:
                assert np.isnan(own[k, c]).all()


def test_quantiles_of_ties_and_neighbouring_numbers(spark):
    up = np.nextafter(1.0, 2)
    values = [1.0] * 400 + [float(up)] * 300 + [float(np.nextafter(up, 2))] * 5 + [-1e300, 1e300, None, float("inf"), float("nan")]
    df = spark.createDataFrame([(v, 1.0) for v in values], "v double, y double")
    table = bl.blocks(df, ["v"], ["y"], day=None, ids=())
    known = np.array(values[:-3], float)
    wanted = np.linspace(0, 1, 15)
    assert np.array_equal(selection.quantiles(table, [selection.Window(0, 0)], wanted)[0, 0], np.quantile(known, wanted))


def solution(x, y, strength, balanced=True):
    """Coefficients by plain Newton iteration on a dense matrix."""
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    deviation = x.std(axis=0)
    x = np.column_stack([(x - x.mean(axis=0)) / np.where(deviation > 0, deviation, 1), np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    b, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 1 / strength), 0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b - np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag(penalty), x.T @ (w * (p - y)) + penalty * b)
    return b, 1 / (1 + np.exp(-x @ b))


def test_newton_equals_the_dense_solution(table, rows):
    label = {"y": 6, "z": 7}
    cases = [
        md.Case(0, k, name, features, kind, (day(a), day(b)), (day(b + 1), day(b + 9)))
        for k, (a, b, name, features, kind) in enumerate([
            (0, 40, "y", ("a", "b", "c"), "logistic_regression"), (0, 40, "y", ("b",), "logistic_regression"), (15, 70, "y", ("a", "b", "c"), "regularized_logistic"),
            (15, 70, "z", ("a", "b", "c", "d"), "logistic_regression"),
        ])
    ]
    for c, m in zip(cases, md.fit_cases(table, cases)):
        start, end = (d - day(0) for d in c.train)
        x, y = dense(rows, start, end, label[c.label], [2 + VALUES.index(f) for f in c.features])
        b, p = solution(x, y, 0.25 if c.kind == "regularized_logistic" else 1.0)
        assert np.allclose(m.coefficients, b, atol=1e-7)
        whole = dense(rows, start, end, label[c.label])[0]
        assert np.allclose(m.probability(whole), p, atol=1e-7)


def test_far_first_steps_are_shortened(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 200), [4000.0]])
    df = spark.createDataFrame([(float(v), float(v > 0.5)) for v in x], "v double, y double")
    table = bl.blocks(df, ["v"], ["y"], day=None, ids=())
    (model,) = md.fit_cases(table, [md.Case(0, 0, "y", ("v",), "logistic_regression", (0, 0), (0, 0))])
    b, _ = solution(x[:, None], (x > 0.5).astype(float), 1.0)
    assert np.allclose(model.coefficients, b, atol=1e-6)


def gini(mass):
    return 2 * mass[0] * mass[1] / mass.sum() if mass.sum() else 0.0


def test_forest_splits_equal_brute_force(table, rows):
    case = md.Case(0, 0, "y", ("a", "b", "c", "d"), "random_forest_shallow", (day(0), day(70)), (day(71), day(80)))
    frame = linear.frames(table, [selection.Window(*case.train, 0)], selection.summarize(table, [selection.Window(*case.train, 0)]))[0]
    edges = forests.edges(table)
    ids = {}
    for block in table.table.collect():
        days, keys = np.frombuffer(block.days, np.int32), np.frombuffer(block.rows, np.int64)
        x, y = (np.frombuffer(v, float).reshape(len(days), -1) for v in (block.x, block.y))
        ids.update({k: (d, *row, lab) for k, d, row, lab in zip(keys.tolist(), days.tolist(), x.tolist(), y[:, 0].tolist())})
    own = [(k, v) for k, v in ids.items() if case.train[0] <= v[0] <= case.train[1] and not np.isnan(v[5])]
    keys, x, y = np.array([k for k, _ in own]), np.array([v[1:5] for _, v in own]), np.array([v[5] for _, v in own]).astype(int)
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    for balanced in (False, True):
        model = forests.Forest(frame, np.arange(4), edges, 6, 3, 8, balanced, 3)
        forests.fit(table, [model])
        for t in range(model.trees):
            times = forests.bootstrap(keys, t, 3)
            sample = np.bincount(y, times, 2)
            weights = sample.sum() / (2 * sample) if balanced else np.ones(2)
            reached = {0: times > 0}
            for node in range(7):
                if node not in reached:
                    assert model.column[t, node] == -1
                    continue
                here = reached[node]
                mass = np.bincount(y[here], times[here], 2) * weights
                assert np.isclose(model.value[t, node], mass[1] / mass.sum())
                best = None
                for c in forests.sampled(4, t, np.array([node]), 3)[0]:
                    for e, edge in enumerate(edges[c]):
                        left, right = here & (x[:, c] <= edge), here & (x[:, c] > edge)
                        if times[left].sum() >= 8 and times[right].sum() >= 8:
                            apart = sum(gini(np.bincount(y[s], times[s], 2) * weights) for s in (left, right))
                            if best is None or apart < best[0] - 1e-8:
                                best = (apart, c, e, left, right)
                if best is None or gini(mass) < 1e-12:
                    assert model.column[t, node] == -1
                    continue
                assert (model.column[t, node], model.edge[t, node]) == (best[1], best[2])
                reached[2 * node + 1], reached[2 * node + 2] = best[3], best[4]
        whole = model.probability(x)
        assert ((whole > 0.5) == (y == 1)).mean() > 0.75 and abs(model.strengths().sum() - 1) < 1e-9


def test_bootstrap_draws_are_poisson():
    times = forests.bootstrap(np.arange(200_000), 5, 42)
    assert abs(times.mean() - 1) < 0.01 and abs((times == 0).mean() - np.exp(-1)) < 0.005


def test_one_pass_serves_all_models(spark, panel, monkeypatch):
    """The number of jobs does not grow with runs or folds."""
    jobs = []
    real = bl.Blocks.map
    monkeypatch.setattr(bl.Blocks, "map", lambda self, *a, **k: jobs.append(1) or real(self, *a, **k))
    options = {"train": 20, "test": 10, "embargo": 2, "horizon": 2}
    one, _ = md.validate_many(panel, [md.Run(("a",), "y", **options)])
    alone, jobs[:] = len(jobs), []
    runs = [md.Run(f, label, tags=(("label", label), ("n", str(len(f)))), **options) for label in ("y", "z") for f in (("a",), ("a", "b"), ("a", "b", "c"))]
    many, strengths = md.validate_many(panel, runs)
    assert len(jobs) <= 2 * alone  # not 6 times: rounds and steps depend on the hardest column and model
    mine = many.filter("label = 'y' AND n = '1'")
    assert {(r.fold, r.date, r.ticker): round(r.probability, 9) for r in one.collect()} == {(r.fold, r.date, r.ticker): round(r.probability, 9) for r in mine.collect()}
    assert strengths.count() == 2 * 6 * one.select("fold").distinct().count()


def test_selection_per_fold(panel):
    out, strengths = md.validate(panel, ["a", "b", "c"], "y", kind="auto", train=30, test=15, embargo=2, horizon=2)
    chosen = {r.fold: r.selected_model for r in out.collect()}
    assert len(chosen) == 3 and set(chosen.values()) <= set(md.CANDIDATES)
    assert out.filter("actual IS NULL").count() == 0 and strengths.filter(F.col("importance").isNull()).count() == 0


def test_open_end_scores_unlabelled_rows(panel):
    options = {"train": 30, "test": 25, "embargo": 2, "horizon": 2}
    closed, _ = md.validate(panel, ["a", "b"], "y", **options)
    opened, _ = md.validate(panel, ["a", "b"], "y", open_end=True, **options)
    assert opened.filter("actual IS NULL").count() > 0 and opened.agg(F.max("date")).first()[0] > closed.agg(F.max("date")).first()[0]
