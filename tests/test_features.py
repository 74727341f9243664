"""Closed-form values, causality and transform identities."""

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tickerloom.operators import features as ft
from tickerloom.operators import labels as lb
from tickerloom.operators import regime as rg
from tickerloom.operators import transforms as tr
from workload import fixtures as fx

DAY = dt.date(2020, 1, 1)


def bars(spark, prices, ticker="A", volume=None):
    rows = [
        (ticker, DAY + dt.timedelta(days=i), float(p), float(p) * 1.01, float(p) * 0.99, float(p), float(p), float(volume[i] if volume else 10 + i % 3))
        for i, p in enumerate(prices)
    ]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double")


def values(df, column):
    return [r[0] for r in df.orderBy("date").select(column).collect()]


def wave(n, seed=1):
    rnd = random.Random(seed)
    out, p = [], 100.0
    for _ in range(n):
        p *= 1 + rnd.gauss(0.0005, 0.02)
        out.append(p)
    return out


def test_drawdown_matches_a_scan(spark):
    prices = wave(150)
    got = values(ft.drawdowns(bars(spark, prices), (7, 60, 120)), "max_drawdown_60d")
    for i, x in enumerate(got):
        if i < 59:
            assert x is None
            continue
        peak, worst = 0.0, 0.0
        for p in prices[i - 59 : i + 1]:
            peak = max(peak, p)
            worst = min(worst, p / peak - 1)
        assert x == worst


def test_means_and_deviations_match_numpy(spark):
    prices = wave(90)
    df = ft.combine(bars(spark, prices), ft.volatility_stages((20,)), ft.average_stages((50,)))
    vol, ma = values(df, "volatility_20d"), values(df, "ma_50d")
    ret = [None] + [b / a - 1 for a, b in zip(prices, prices[1:])]
    assert vol[19] is None and math.isclose(vol[20], np.std(ret[1:21], ddof=1) * math.sqrt(252), rel_tol=1e-9)
    assert ma[48] is None and math.isclose(ma[60], np.mean(prices[11:61]), rel_tol=1e-12)


def test_constant_volume_has_no_z_score(spark):
    got = values(ft.volume_z(bars(spark, wave(30), volume=[7.1] * 30), (20,)), "volume_z_20d")
    assert got == [None] * 30


def test_rsi_edges(spark):
    assert values(ft.rsi(bars(spark, range(10, 40))), "rsi_14d")[20] == 100.0
    assert values(ft.rsi(bars(spark, [5.0] * 20)), "rsi_14d")[18] == 50.0


def test_median_of_even_and_odd_windows(spark):
    from tickerloom.functions.frames import rolled_median

    got = values(bars(spark, [1, 5, 2, 8, 3]).withColumn("m", rolled_median("adj_close", 4, 2)), "m")
    assert got == [None, 3.0, 2.0, 3.5, 4.0]


def test_collected_median_equals_the_sorted_frame(spark):
    from tickerloom.functions.frames import rolled_median, with_rolled_median

    prices = [None if i % 11 == 3 else (i * 37 % 101) / 7 for i in range(150)] + [None] * 9
    df = bars(spark, range(159)).withColumn("x", F.element_at(F.array(*[F.lit(p).cast("double") for p in prices]), (F.col("adj_close") + 1).cast("int")))
    got = with_rolled_median(df, "x", 8, 3, "m").withColumn("framed", rolled_median("x", 8, 3))
    assert values(got, "m") == values(got, "framed")


def test_technical_keeps_its_column_order(spark):
    names = ft.technical(bars(spark, wave(5))).columns
    assert names[-2:] == ["max_drawdown_60d", "max_drawdown_120d"] and names.index("return_5d") < names.index("rsi_14d")


def test_technical_runs_few_windows(spark):
    """Each window operator copies its whole row: the chain must stay short."""
    plan = ft.technical(bars(spark, wave(5)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 9


def test_benchmark_is_carried_on_own_dates_only(spark):
    own = bars(spark, [1, 2, 3, 4])
    bench = spark.createDataFrame(
        [("SPY", DAY, 10.0), ("SPY", DAY + dt.timedelta(days=2), 12.0), ("SPY", DAY + dt.timedelta(days=30), 99.0)], "symbol string, date date, price double"
    )
    assert values(ft.with_benchmarks(own, bench, ["SPY"]), "px_spy") == [10.0, 10.0, 12.0, 12.0]


def test_forward_labels_end_unknown(spark):
    df = bars(spark, [100, 90, 120, 80, 100]).withColumn("px_spy", F.lit(1.0))
    out = lb.forward_labels(df, "SPY", 2)
    assert [None if x is None else round(x, 6) for x in values(out, "forward_2d_return")] == [0.2, -0.111111, -0.166667, None, None]
    assert [None if x is None else round(x, 6) for x in values(out, "forward_2d_drawdown")] == [-0.1, -0.111111, -0.333333, None, None]
    assert values(out, "label_outperform_2d") == [1.0, 0.0, 0.0, None, None]


def test_future_rows_do_not_change_the_past(spark):
    prices = wave(320, 5)
    cut = 250
    bent = prices[:cut] + [p * 3 for p in prices[cut:]]

    def run(series):
        df = tr.wavelet(tr.fourier(ft.technical(bars(spark, series))))
        df = rg.classify(df, causal=True)
        return [tuple(r) for r in df.orderBy("date").limit(cut).collect()]

    assert run(prices) == run(bent)


def test_wavelet_matrices_are_orthogonal():
    details, approx = tr.wavelet_matrices(64, 3)
    whole = np.vstack([*details, approx])
    assert whole.shape == (64, 64)
    assert np.allclose(whole @ whole.T, np.eye(64), atol=1e-9)
    x = np.random.default_rng(0).normal(size=64)
    assert math.isclose((whole @ x) @ (whole @ x), x @ x, rel_tol=1e-9)


def test_pure_cycle_has_one_frequency():
    t = np.arange(60)
    out = tr.spectral_matrix(np.sin(2 * np.pi * 5 * t / 60)[None, :], 3)[0]
    names = tr.spectral_fields(3)
    assert math.isclose(out[names.index("freq_1")], 5 / 60)
    assert math.isclose(out[names.index("energy_concentration")], 1.0, rel_tol=1e-9)
    assert np.isnan(tr.spectral_matrix(np.zeros((1, 60)), 3)).all()


def test_calendar_shared_by_all_windows(spark, sf):
    """One exchange by ticker serves every feature stage."""
    plan = ft.technical(fx.bars(spark, sf), fx.benchmarks(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 14
