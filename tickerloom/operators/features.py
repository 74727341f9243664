"""Trailing technical features; a row at ``t`` uses rows up to ``t`` only.

A feature is a list of stages, each a dict of columns that may use windows over
columns of earlier stages.  ``combine`` evaluates stage ``i`` of all features
together, so Spark plans one window operator per stage (not per feature) over a
single shuffle and sort by ticker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import frames as fr
from tickerloom.functions.stats import over
from tickerloom.functions.trailing import with_trailing

Stages = list[dict[str, Column]]

#: Output, column, rows and least known rows of the median behind the volatility threshold.
THRESHOLD_MEDIANS = [("vol_median", "volatility_60d", 252, 60)]


def combine(df: DataFrame, *features: Stages) -> DataFrame:
    """Evaluate features stage by stage and drop the ``_`` helper columns."""
    for i in range(max(len(f) for f in features)):
        merged = {}
        for f in features:
            merged |= f[i] if i < len(f) else {}
        df = df.withColumns(merged)
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def returns_stages(windows: Sequence[int] = (5, 20, 60, 120)) -> Stages:
    return [{f"return_{w}d": fr.change("adj_close", w) for w in windows}]


def volatility_stages(windows: Sequence[int] = (20, 60), annual: bool = True) -> Stages:
    scale = F.sqrt(F.lit(252.0)) if annual else F.lit(1.0)
    return [
        {"daily_return": fr.change("adj_close")},
        fr.running_totals("daily_return", squares=True),
        {f"volatility_{w}d": fr.running_std("daily_return", w) * scale for w in windows},
    ]


def average_stages(windows: Sequence[int] = (50, 200)) -> Stages:
    return [
        fr.running_totals("adj_close"),
        {f"ma_{w}d": fr.running_mean("adj_close", w) for w in windows},
        {f"dist_ma_{w}d": over(F.col("adj_close"), F.col(f"ma_{w}d")) - 1 for w in windows},
    ]


def volume_stages(windows: Sequence[int] = (20, 60)) -> Stages:
    """z-score; NULL when the window holds one repeated volume."""
    steady = "_changes_volume"
    z = {}
    for w in windows:
        spread = F.when(fr.since(steady, w - 1) > 0, fr.running_std("volume", w))
        z[f"volume_z_{w}d"] = (F.col("volume") - fr.running_mean("volume", w)) / F.nullif(spread, F.lit(0.0))
    changed = (~F.col("volume").eqNullSafe(F.lag("volume").over(fr.entity()))).cast("long")
    return [
        {"_changed_volume": changed},
        fr.running_totals("volume", squares=True) | {steady: F.sum("_changed_volume").over(fr.to_now())},
        z,
    ]


def rsi_stages(window: int = 14) -> Stages:
    gain = fr.rolled(F.avg(F.greatest(F.col("_move"), F.lit(0.0))), F.col("_move"), window)
    loss = fr.rolled(F.avg(-F.least(F.col("_move"), F.lit(0.0))), F.col("_move"), window)
    value = (
        F.when((F.col("_loss") == 0) & (F.col("_gain") > 0), 100.0)
        .when((F.col("_loss") == 0) & (F.col("_gain") == 0), 50.0)
        .otherwise(100.0 - 100.0 / (1.0 + F.col("_gain") / F.nullif(F.col("_loss"), F.lit(0.0))))
    )
    return [
        {"_move": F.col("adj_close") - F.lag("adj_close").over(fr.entity())},
        {"_gain": gain, "_loss": loss},
        {f"rsi_{window}d": value},
    ]


def strength_stages(symbols: Sequence[str], windows: Sequence[int] = (60, 120)) -> Stages:
    """Trailing return minus the benchmark's; needs ``px_<symbol>`` aligned but not carried."""
    return [
        {f"px_{s.lower()}": fr.carried(f"px_{s.lower()}") for s in symbols},
        {
            f"rs_{s.lower()}_{w}d": fr.change("adj_close", w) - fr.change(f"px_{s.lower()}", w)
            for s in symbols
            for w in windows
        },
    ]


def daily_return(bars: DataFrame) -> DataFrame:
    return bars.withColumn("daily_return", fr.change("adj_close"))


def trailing_returns(bars: DataFrame, windows: Sequence[int] = (5, 20, 60, 120)) -> DataFrame:
    return combine(bars, returns_stages(windows))


def volatility(bars: DataFrame, windows: Sequence[int] = (20, 60), annual: bool = True) -> DataFrame:
    return combine(bars, volatility_stages(windows, annual))


def drawdowns(bars: DataFrame, windows: Sequence[int] = (60, 120)) -> DataFrame:
    """Worst peak-to-trough move inside each trailing window."""
    return with_trailing(bars, [(f"max_drawdown_{w}d", "adj_close", w) for w in windows])


def moving_averages(bars: DataFrame, windows: Sequence[int] = (50, 200)) -> DataFrame:
    return combine(bars, average_stages(windows))


def volume_z(bars: DataFrame, windows: Sequence[int] = (20, 60)) -> DataFrame:
    return combine(bars, volume_stages(windows))


def rsi(bars: DataFrame, window: int = 14) -> DataFrame:
    return combine(bars, rsi_stages(window))


def join_benchmarks(bars: DataFrame, benchmarks: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Add ``px_<symbol>`` on exactly matching dates.

    ``benchmarks`` has ``(symbol, date, price)``.  Pivoted it holds one row per
    calendar date, which bounds the broadcast.
    """
    wide = benchmarks.groupBy("date").agg(
        *[F.max(F.when(F.col("symbol") == s, F.col("price"))).alias(f"px_{s.lower()}") for s in symbols]
    )
    return bars.join(F.broadcast(wide), "date", "left")


def with_benchmarks(bars: DataFrame, benchmarks: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Benchmark prices on the ticker's own dates, carried forward."""
    return combine(join_benchmarks(bars, benchmarks, symbols), strength_stages(symbols)[:1])


def relative_strength(
    bars: DataFrame, benchmarks: DataFrame, symbols: Sequence[str], windows: Sequence[int] = (60, 120)
) -> DataFrame:
    return combine(join_benchmarks(bars, benchmarks, symbols), strength_stages(symbols, windows))


def windowed(
    bars: DataFrame, benchmarks: DataFrame | None = None, symbols: Sequence[str] = ("SPY", "QQQ")
) -> DataFrame:
    """``technical`` without the in-window drawdowns: window functions only, so unused columns cost nothing."""
    features = [
        returns_stages(),
        volatility_stages(),
        average_stages(),
        volume_stages(),
        rsi_stages(),
    ]
    if benchmarks is not None:
        bars = join_benchmarks(bars, benchmarks, symbols)
        features.append(strength_stages(symbols))
    return combine(bars, *features)


def technical(
    bars: DataFrame, benchmarks: DataFrame | None = None, symbols: Sequence[str] = ("SPY", "QQQ"), medians: bool = False
) -> DataFrame:
    """All trailing technical columns with the default windows; ``medians`` adds those that ``regime.classify`` needs, in the same pass."""
    return with_worst(windowed(bars, benchmarks, symbols), medians)


def with_worst(rows: DataFrame, medians: bool = False) -> DataFrame:
    """What ``technical`` adds to ``windowed``.  All columns of ``rows`` go through Python, and windows after it cost an exchange."""
    worst = [(f"max_drawdown_{w}d", "adj_close", w) for w in (60, 120)]
    wanted, typical = (THRESHOLD_MEDIANS, [m[0] for m in THRESHOLD_MEDIANS]) if medians else ([], [])
    return with_trailing(rows, worst, wanted, typical)


def signal_source(price: Column, mode: str) -> Column:
    """Input series of the spectral transform."""
    previous = F.lag(price).over(fr.entity())
    if mode == "returns":
        return over(price, previous) - 1
    if mode == "log_price":
        return F.log(price)
    if mode == "log_returns":
        return F.log(price) - F.log(previous)
    raise ValueError("mode must be returns, log_price or log_returns")
