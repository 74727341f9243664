"""Registered queries against their SQL twins on the smallest tables."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SAMPLE = (
    "bars_normalized", "trailing_returns", "rolling_drawdown", "regimes", "forward_labels", "target_labels", "regime_backtest", "roi_rollup",
    "classification_metrics", "quintiles", "joint_2x2", "event_drift", "pair_correlation", "basket_rotation", "importance_stability", "walk_forward_folds",
)


@pytest.fixture(scope="module")
def duck(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf, duck, name):
    assert check.compare(queries()[name](spark, sf).toPandas(), duck.sql(oracle_sql()[name]).df()) == "ok"


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
