"""Market, theme and single-name stress reads from price history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions import frames as fr
from tickerloom.functions.stats import over


def snapshot(technical: DataFrame) -> DataFrame:
    """Latest known value of every price metric per ticker."""
    price = F.col("adj_close")
    high = F.when(F.count(price).over(fr.trailing(126)) >= 20, F.max(price).over(fr.trailing(126)))
    rows = technical.withColumn("from_126d_high", over(price, high) - 1)
    names = {
        "price": "adj_close",
        "return_20d": "return_20d",
        "return_60d": "return_60d",
        "return_120d": "return_120d",
        "vs_50dma": "dist_ma_50d",
        "vs_200dma": "dist_ma_200d",
        "drawdown_60d": "max_drawdown_60d",
        "drawdown_120d": "max_drawdown_120d",
        "from_126d_high": "from_126d_high",
        "vol_20d": "volatility_20d",
        "vol_60d": "volatility_60d",
    }
    out = rows.groupBy("ticker").agg(
        F.max("date").alias("date"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(n) for n, c in names.items()],
    )
    return out.withColumn(
        "vol_expansion", F.when(F.col("vol_60d") > 0, F.col("vol_20d") / F.col("vol_60d") - 1)
    )


def relative_return(bars: DataFrame, benchmark: DataFrame, output: str, window: int = 60) -> DataFrame:
    """Return minus the benchmark's over the last ``window`` common dates.

    ``benchmark`` is ``(date, price)``, one row per calendar date.
    """
    b = benchmark.select("date", F.col("price").alias("_bp"))
    common = bars.select("ticker", "date", "adj_close").join(F.broadcast(b), "date")
    newest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    ends = common.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k").isin(1, window + 1))

    def at(k: int, c: str) -> Column:
        return F.max(F.when(F.col("_k") == k, F.col(c)))

    return ends.groupBy("ticker").agg(
        (at(1, "adj_close") / at(window + 1, "adj_close") - at(1, "_bp") / at(window + 1, "_bp")).alias(output)
    )


def series_of(bars: DataFrame, ticker: str) -> DataFrame:
    return bars.filter(F.col("ticker") == ticker).select("date", F.col("adj_close").alias("price"))


def _known(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def market_stress(technical: DataFrame, lead: str, base: str, bond: str) -> DataFrame:
    """State of the lead benchmark against the base one; ``bond`` is context only."""
    metrics = snapshot(technical.filter(F.col("ticker").isin(lead, base, bond)))
    rs = relative_return(technical.filter(F.col("ticker") == lead), series_of(technical, base), "rs_60d")
    context = metrics.filter(F.col("ticker") == bond).agg(F.max("vs_200dma").alias("bond_vs_200dma"))
    main = metrics.filter(F.col("ticker") == lead).join(rs, "ticker", "left").crossJoin(F.broadcast(context))
    flags = F.array_compact(
        F.array(
            F.when(_known("vs_200dma") < 0, "below 200DMA"),
            F.when((_known("vs_50dma") < 0) & (_known("return_20d") < 0), "below 50DMA with negative 20d return"),
            F.when(_known("from_126d_high") <= -0.10, "more than 10% below 126d high"),
            F.when(F.col("rs_60d") <= -0.03, "lagging over 60d"),
        )
    )
    state = (
        F.when(F.col("price").isNull() | F.col("rs_60d").isNull(), "Elevated")
        .when((_known("vs_200dma") < 0) | (F.size(flags) >= 3), "Stressed")
        .when(F.size(flags) > 0, "Elevated")
        .otherwise("Normal")
    )
    return main.select(
        state.alias("state"), "rs_60d", "vs_50dma", "vs_200dma", "from_126d_high", "return_20d", "return_60d",
        "vol_expansion", "bond_vs_200dma", F.array_join(flags, "; ").alias("deterioration"),
        (_known("vol_expansion") >= 0.25).alias("volatility_warning"),
    )


def theme_stress(technical: DataFrame, themes: Sequence[str], base: str) -> DataFrame:
    """Weak / stressed / cooling per theme ticker and the combined state."""
    mine = technical.filter(F.col("ticker").isin(*themes))
    rs = relative_return(mine, series_of(technical, base), "rs_60d")
    found = snapshot(mine).join(rs, "ticker", "left")
    listed = technical.sparkSession.createDataFrame([(t,) for t in themes], "ticker string")
    rows = listed.join(found, "ticker", "left")
    missing = F.col("price").isNull() | F.col("rs_60d").isNull()
    weak = missing | (_known("vs_50dma") < 0) | F.coalesce(F.col("rs_60d") <= -0.03, F.lit(False)) | (_known("from_126d_high") <= -0.10)
    stressed = (_known("vs_200dma") < 0) | F.coalesce(F.col("rs_60d") <= -0.08, F.lit(False)) | (_known("from_126d_high") <= -0.18)
    cooling = ~weak & (F.coalesce(F.col("return_20d") < 0, F.lit(False)) | F.coalesce(F.col("from_126d_high") <= -0.05, F.lit(False)))
    read = (
        F.when(missing, "incomplete").when(stressed, "stressed").when(weak, "weakening").when(cooling, "cooling").otherwise("healthy")
    )
    marked = rows.withColumns({"_m": missing, "_w": weak, "_s": stressed, "read": read})
    totals = marked.agg(F.count_if("_m").alias("m"), F.count_if("_w").alias("w"), F.count_if("_s").alias("s"))
    n = len(themes)
    state = (
        F.when(F.col("s") == n, "Stressed").when(F.col("m") > 0, "Mixed").when(F.col("w") == 0, "Healthy")
        .when(F.col("w") == n, "Weakening").otherwise("Mixed")
    )
    return marked.crossJoin(F.broadcast(totals)).select(
        state.alias("state"), "ticker", "rs_60d", "vs_50dma", "vs_200dma", "from_126d_high", "return_20d", "return_60d", "read"
    )


def trend_health(technical: DataFrame, base: DataFrame, theme: DataFrame) -> DataFrame:
    """Six ordered states for every ticker of the universe."""
    rows = (
        snapshot(technical)
        .join(relative_return(technical, base, "rs_base_60d"), "ticker", "left")
        .join(relative_return(technical, theme, "rs_theme_60d"), "ticker", "left")
    )
    no = F.lit(False)
    below50, below200 = F.coalesce(F.col("vs_50dma") < 0, no), F.coalesce(F.col("vs_200dma") < 0, no)
    rs = F.col("rs_base_60d")
    damaged = (
        F.coalesce(F.col("drawdown_120d") <= -0.20, no)
        | F.coalesce(F.col("return_60d") <= -0.10, no)
        | F.coalesce(rs <= -0.08, no)
    )
    state = (
        F.when(F.col("price").isNull(), "Watch only")
        .when(below200 & damaged, "Risk reduction candidate")
        .when(below200 | (below50 & (_known("return_60d") < 0) & (_known("rs_base_60d") < 0)), "Trend damage")
        .when((_known("vs_50dma") >= 0.12) & (_known("return_20d") >= 0.08) & (_known("from_126d_high") >= -0.05), "Extended, do not chase")
        .when(~below200 & (below50 | F.coalesce(F.col("drawdown_60d").between(-0.12, -0.05), no)), "Normal pullback")
        .when(
            (_known("vs_50dma") >= 0) & (_known("vs_200dma") >= 0) & (_known("return_60d") >= 0)
            & F.coalesce(rs >= -0.02, F.lit(True)),
            "Healthy trend",
        )
        .otherwise("Watch only")
    )
    return rows.withColumn("state", state)



def trend_flag(benchmark: DataFrame, rows: int = 200) -> DataFrame:
    """Is the last price at or above the mean of the last ``rows`` rows; NULL with fewer."""
    newest = benchmark.withColumn("_k", F.row_number().over(Window.orderBy(F.col("date").desc()))).filter(F.col("_k") <= rows)
    return newest.agg(
        F.max("date").alias("as_of"),
        F.when(F.count("price") == rows, F.max_by("price", "date") >= F.avg("price")).alias("above_200dma"),
    )


def broad_pullback(sectors: DataFrame, benchmark: DataFrame, names: int) -> DataFrame:
    """All ``names`` sectors down over five rows while the benchmark holds its 200-row mean."""
    calendar = Window.orderBy(F.col("date").desc())
    signal = benchmark.withColumn("_k", F.row_number().over(calendar)).filter(F.col("_k") <= 6).select("date", "_k")
    aligned = (
        sectors.join(F.broadcast(signal), "date")
        .groupBy("ticker")
        .agg(
            F.count_if(F.col("adj_close") > 0).alias("n"),
            (F.max(F.when(F.col("_k") == 1, F.col("adj_close"))) / F.max(F.when(F.col("_k") == 6, F.col("adj_close"))) - 1).alias("ret"),
        )
        .filter("n = 6")
        .agg(F.count(F.lit(1)).alias("available_sector_count"), F.count_if(F.col("ret") < 0).alias("negative_sector_count"))
    )
    status = (
        F.when((F.col("available_sector_count") < names) | F.col("above_200dma").isNull(), "Unavailable")
        .when((F.col("negative_sector_count") == names) & F.col("above_200dma"), "Confirmed")
        .otherwise("Not confirmed")
    )
    return aligned.crossJoin(F.broadcast(trend_flag(benchmark))).select(
        status.alias("status"), "as_of", "negative_sector_count", "available_sector_count", "above_200dma"
    )
