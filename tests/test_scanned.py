"""Model inputs read from one stored panel."""

import random
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pytest

from tickerloom.operators import models as md
from tickerloom.operators import transforms as tr
from tickerloom.plans import blocks as bl
from tickerloom.plans import selection
from tickerloom.plans.storage import checkpoint_dir, stored


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(5)
    rows = []
    for i in range(130):
        for ticker in "ABCDEF":
            a = rng.gauss(0, 1)
            rows.append((ticker, date(2020, 1, 1) + timedelta(i), a if rng.random() > 0.1 else None, rng.random(), float(a + rng.gauss(0, 1) > 0) if rng.random() > 0.1 else None))
    rng.shuffle(rows)
    return stored(spark.createDataFrame([*rows, ("G", None, 1.0, 1.0, 1.0)], "ticker string, date date, a double, b double, y double").repartition(5))


def day(i):
    return (date(2020, 1, 1) + timedelta(i) - date(1970, 1, 1)).days


def test_scanned_blocks_sum_as_packed_ones(panel):
    known = panel.filter("date IS NOT NULL")
    windows = [selection.Window(day(a), day(b), label) for a, b, label in ((0, 40, 0), (20, 60, 0), (20, 60, None), (120, 400, 0))]
    one, other = (selection.summarize(t, windows) for t in (bl.scanned(panel, ["a", "b"], ["y"]), bl.blocks(known, ["a", "b"], ["y"])))
    for name in ("known", "low", "high", "rows", "positive"):
        assert np.array_equal(getattr(one, name), getattr(other, name), equal_nan=True)


def test_linear_fits_write_no_second_panel(spark, panel):
    root = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = {p.name for p in root.iterdir()}
    known = panel.filter("date IS NOT NULL")
    out, strengths = md.validate(known, ["a", "b"], "y", train=40, test=40, embargo=5, horizon=3)
    assert not [p for p in root.iterdir() if p.name not in before and p.name.startswith("blocks-")]
    packed = bl.blocks(known, ["a", "b"], ["y"])
    cases = [md.Case(0, 1, "y", ("a", "b"), "logistic_regression", (day(0), day(39)), (day(45), day(84)))]
    [model] = md.fit_cases(packed, cases)
    own = {r.feature: r.importance for r in strengths.filter("fold = 1").collect()}
    assert np.allclose([own["a"], own["b"]], model.strengths(), atol=1e-6)
    assert out.filter("fold = 1").count() == known.filter(f"y IS NOT NULL AND unix_date(date) BETWEEN {day(45)} AND {day(84)}").count()


def test_waves_in_one_call_without_a_join(spark):
    rng = random.Random(6)
    bars = spark.createDataFrame([(t, date(2020, 1, 1) + timedelta(i), 50 + 10 * rng.random(), i) for t in "AB" for i in range(90)], "ticker string, date date, adj_close double, other int")
    one, two = tr.waves(bars), tr.wavelet(tr.fourier(bars))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert one.columns == two.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
