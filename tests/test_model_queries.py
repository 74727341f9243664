"""What the model queries pass to the operators."""

import random
from datetime import date, timedelta

import pytest

from __spark_entry__ import queries
from tickerloom.operators import labels as lb
from tickerloom.operators import models as md
from tickerloom.operators import robustness as rb
from workload import q_models as qm

FEATURES = ["return_20d", "volatility_20d", "fourier_cycle_clarity", "wavelet_clean_trend"]
DEFAULTS = {"train": 252, "test": 63, "step": None, "embargo": 20, "horizon": 20}
BOTH = ("feature_group_comparison", "ablation")


class Passed(Exception):
    pass


@pytest.fixture
def panel(spark, monkeypatch):
    rows = [(f"T{i % 3}", i, *((i * k) % 7 + 0.5 for k in (1, 2, 3, 5)), float(i % 2), float(i % 3 == 0)) for i in range(30)]
    columns = ["ticker", "date", *FEATURES, "label_outperform_20d", "label_drawdown_risk_20d"]
    panel = spark.createDataFrame(rows, columns)
    monkeypatch.setattr(qm, "_full_panel", lambda spark, sf: panel)
    return panel


@pytest.mark.parametrize("name", ["walk_forward_predictions", "walk_forward_importance", "model_selection", *BOTH, "score_history", "top_importance"])
def test_default_windows_and_all_features(spark, panel, monkeypatch, name):
    passed = []

    def validate_many(panel, runs, *args, **options):
        passed.extend(runs)
        raise Passed

    monkeypatch.setattr(md, "validate_many", validate_many)
    with pytest.raises(Passed):
        queries()[name](spark, "unused")
    assert all({k: getattr(run, k) for k in DEFAULTS} == DEFAULTS for run in passed)
    assert list(passed[0].features) == (FEATURES[:2] if name in BOTH else FEATURES)
    assert len(passed) == (4 if name in BOTH else 1 + (name == "score_history"))


def test_default_windows_give_all_folds(spark):
    from tickerloom.operators import folds as fo

    days = spark.range(2500).selectExpr("date_add(DATE'2015-01-01', CAST(id AS INT)) AS date")
    bounds = fo.walk_forward(days).agg({"fold": "max"}).first()[0]
    assert bounds == (2500 - 252 - 20) // 63 == 35


@pytest.fixture(scope="module")
def features(spark):
    """Two tickers of 130 dates with two benchmark prices."""
    rng = random.Random(4)
    rows = []
    for ticker in ("A", "B"):
        price = 100.0
        for i in range(130):
            move = max(-0.7, rng.gauss(0.05, 0.3))
            price *= 1 + move
            rows.append((ticker, date(2020, 1, 1) + timedelta(i), price, 100.0 + i % 9, 100.0 - i % 7, "Uptrend" if i % 3 else "Downtrend", move, move * move, rng.random()))
    return spark.createDataFrame(rows, ["ticker", "date", "adj_close", "px_spy", "px_qqq", "regime", "return_5", "wavelet_x", "fourier_x"]).cache()


def test_robustness_refits_every_axis(spark, features, monkeypatch):
    fits, real = [], rb.validate_many

    def validate_many(panel, runs, **options):
        fits.extend((run.features, run.label, run.train, run.horizon) for run in runs)
        return real(panel, runs, **options)

    monkeypatch.setattr(rb, "validate_many", validate_many)
    cases = rb.grid(
        features, {"technical": ["return_5"]}, features, features.select("date").distinct(), horizons=(3, 5), ml_thresholds=(0.5, 0.6), risk_thresholds=(0.6,),
        costs_bps=(0.0, 100.0), slippages_bps=(0.0,), trains=(40,), test=40, embargo=5,
    ).collect()
    assert len(fits) == 2 * 2 + 2  # a risk model serves both benchmarks, and all thresholds and costs
    of = {(c.benchmark, c.horizon, c.ml_threshold, c.transaction_cost_bps): c for c in cases}
    assert len(cases) == len(of) == 2 * 2 * 2 * 2
    base = of["SPY", 3, 0.5, 0.0]
    assert base.brier_score != of["QQQ", 3, 0.5, 0.0].brier_score != of["QQQ", 5, 0.5, 0.0].brier_score
    assert base.portfolio_average_exposure > 0 and base.portfolio_sharpe > of["SPY", 3, 0.5, 100.0].portfolio_sharpe


def test_group_predictions_are_fitted_per_target_and_group(spark, features):
    panel = lb.forward_labels(features, "SPY", 3).cache()
    groups = {"technical": ["return_5"], "technical_wavelet": ["return_5", "wavelet_x"]}
    targets = {"out": "label_outperform_3d", "risk": "label_drawdown_risk_3d"}
    out = md.group_predictions(panel, groups, targets, keep=("regime",), train=40, test=40, embargo=5)
    seen = {(r.target_id, r.feature_group): r["avg(probability)"] for r in out.groupBy("target_id", "feature_group").avg("probability").collect()}
    assert len(seen) == 4 and seen["out", "technical"] != seen["out", "technical_wavelet"]
    one = md.validate(panel, ["return_5"], "label_outperform_3d", train=40, test=40, embargo=5, horizon=3)[0]
    assert abs(one.agg({"probability": "avg"}).first()[0] - seen["out", "technical"]) < 1e-9


def test_model_twins_of_the_formula_queries_are_registered():
    assert {"robustness_cases", "target_feature_group_models", "target_stability_models", "risk_feature_group_models"} <= queries().keys()
