"""Drawdowns and medians of trailing windows: one pass, whatever the batches."""

import datetime as dt
import random

import pytest

from tickerloom.functions.trailing import with_trailing
from tickerloom.operators import features as ft
from tickerloom.operators import regime as rg
from workload import fixtures as fx

DAY = dt.date(2020, 1, 1)


def plain(prices, rows, minimum):
    """(worst move, median) of each row's window, by its definition."""
    out = []
    for i in range(len(prices)):
        own = prices[max(0, i - rows + 1) : i + 1]
        known = sorted(p for p in own if p is not None)
        middle = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2 if len(known) >= minimum else None
        peak, worst = None, 0.0
        for p in (p for p in own if p is not None):
            peak = p if peak is None else max(peak, p)
            worst = min(worst, p / peak - 1) if peak else worst
        out.append((worst if i >= rows - 1 else None, middle))
    return out


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_windows_end_at_tickers_not_at_batches(spark, batch):
    rnd = random.Random(3)
    series = {f"S{n}": [None if rnd.random() < 0.2 else round(rnd.uniform(0, 9)) + 0.5 * rnd.random() for _ in range(n)] for n in (1, 4, 5, 6, 23, 60)}
    series["none"], series["zero"] = [None] * 9, [0.0] * 9
    rows = [(t, DAY + dt.timedelta(days=i), p) for t, own in series.items() for i, p in enumerate(own)]
    rnd.shuffle(rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(rows, "ticker string, date date, x double").coalesce(1)
        got = with_trailing(df, [("worst", "x", 5)], [("mid", "x", 6, 3)], ["mid"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(rows)
    for ticker, own in series.items():
        mine = sorted((r for r in got if r.ticker == ticker), key=lambda r: r.date)
        worst, mids = [x for x, _ in plain(own, 5, 3)], [m for _, m in plain(own, 6, 3)]
        assert [r.worst for r in mine] == worst and [r.mid for r in mine] == mids
        known = sorted(m for m in mids if m is not None)
        typical = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2 if known else None
        assert {r.mid_typical for r in mine} == {typical}


def test_regimes_take_one_pass_over_few_windows(spark, sf):
    """Neither a window per block of a drawdown nor a row that carries its ticker's whole history."""
    plan = fx.featured(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 9 and plan.count("MapInArrow") == 1 and "percentile" not in plan
    bars = fx.bars(spark, sf)
    extra = set(rg.classify(ft.technical(bars, medians=True)).columns) - set(ft.technical(bars).columns)
    assert extra == {"regime", "regime_rationale", "risk_flags"}


def test_books_of_a_grid_do_not_multiply_rows(spark, sf):
    from workload import QUERIES

    plan = QUERIES["strategy_grid"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # from the top: rows are made from the summaries


def test_an_inventory_builds_the_features_once(spark, sf):
    from workload import QUERIES

    plan = QUERIES["feature_inventory"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
