"""Equal-weight basket rotation against a benchmark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.cockpit import trend_flag


def detail(bars: DataFrame, baskets: DataFrame, benchmark: DataFrame, windows: Sequence[int] = (1, 5, 20, 60)) -> DataFrame:
    """One row per layer and window.

    ``baskets`` is ``(layer, ticker)``; ``benchmark`` is ``(date, price)``.  A
    constituent counts when it has a price on each of the last ``w + 1``
    benchmark dates.
    """
    newest = Window.orderBy(F.col("date").desc())
    calendar = (
        benchmark.withColumn("_k", F.row_number().over(newest))
        .filter(F.col("_k") <= max(windows) + 1)
        .withColumn("_b", F.col("price") / F.lead("price").over(newest) - 1)
    )
    spans = benchmark.sparkSession.createDataFrame([(w,) for w in windows], "window int")
    days = calendar.join(F.broadcast(spans), F.col("_k") <= F.col("window") + 1)
    bench = days.groupBy("window").agg(
        F.product(F.when(F.col("_k") <= F.col("window"), 1 + F.col("_b"))).alias("_bp"),
        F.count(F.lit(1)).alias("_bn"),
        F.max("date").alias("as_of"),
    ).withColumn("benchmark_return", F.when(F.col("_bn") == F.col("window") + 1, F.col("_bp") - 1))
    entity = Window.partitionBy("layer", "ticker").orderBy("date")
    priced = (
        bars.select("ticker", "date", "adj_close")
        .join(F.broadcast(calendar.select("date", "_k")), "date")
        .join(baskets, "ticker")
        .withColumn("_r", F.col("adj_close") / F.lag("adj_close").over(entity) - 1)
        .join(F.broadcast(spans), F.col("_k") <= F.col("window") + 1)
    )
    whole = Window.partitionBy("layer", "window", "ticker")
    full = priced.withColumn("_n", F.count("adj_close").over(whole)).filter(F.col("_n") == F.col("window") + 1)
    members = full.groupBy("layer", "window", "ticker").agg(
        (F.max(F.when(F.col("_k") == 1, F.col("adj_close"))) / F.max(F.when(F.col("_k") == F.col("window") + 1, F.col("adj_close"))) - 1).alias("ret")
    ).groupBy("layer", "window").agg(
        F.array_join(F.sort_array(F.collect_list("ticker")), ",").alias("available_constituents"),
        F.count(F.lit(1)).alias("_available"),
        F.avg((F.col("ret") > 0).cast("double")).alias("breadth"),
    )
    daily = full.filter(F.col("_k") <= F.col("window")).groupBy("layer", "window", "date").agg(F.avg("_r").alias("r"))
    path = Window.partitionBy("layer", "window").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    walked = daily.withColumn("wealth", F.product(1 + F.col("r")).over(path))
    walked = walked.withColumn("dd", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(path)) - 1)
    basket = walked.groupBy("layer", "window").agg(
        (F.product(1 + F.col("r")) - 1).alias("basket_return"),
        F.when(F.count("r") > 1, F.stddev_pop("r") * F.sqrt(F.lit(252.0))).alias("annualized_volatility"),
        F.least(F.lit(0.0), F.min("dd")).alias("max_drawdown"),
    )
    listed = baskets.groupBy("layer").agg(
        F.array_join(F.sort_array(F.collect_list("ticker")), ",").alias("tickers"), F.count(F.lit(1)).alias("constituent_count")
    )
    return (
        listed.crossJoin(F.broadcast(bench))
        .join(members, ["layer", "window"], "left")
        .join(basket, ["layer", "window"], "left")
        .select(
            "as_of",
            "layer",
            "tickers",
            "window",
            F.coalesce("available_constituents", F.lit("")).alias("available_constituents"),
            "constituent_count",
            (F.coalesce("_available", F.lit(0)) / F.col("constituent_count")).alias("coverage"),
            "basket_return",
            F.when(F.col("basket_return").isNotNull(), F.col("benchmark_return")).alias("benchmark_return"),
            (F.col("basket_return") - F.col("benchmark_return")).alias("relative_return"),
            "breadth",
            "annualized_volatility",
            "max_drawdown",
        )
    )


def summary(detail_rows: DataFrame, benchmark: DataFrame, signal_window: int = 5) -> DataFrame:
    """Leader, laggard and market state over one signal window."""
    now = detail_rows.filter(F.col("window") == signal_window)
    known = F.col("basket_return").isNotNull() & F.col("relative_return").isNotNull()
    one = now.agg(
        F.max("as_of").alias("as_of"),
        F.count(F.lit(1)).alias("layers"),
        F.count_if(known).alias("available_layer_count"),
        F.count_if(F.col("basket_return") > 0).alias("positive_layer_count"),
        F.count_if(F.col("basket_return") < 0).alias("negative_layer_count"),
        F.max(F.when(known, F.struct("relative_return", "layer"))).alias("lead"),
        F.min(F.when(known, F.struct("relative_return", "layer"))).alias("lag"),
    ).crossJoin(F.broadcast(trend_flag(benchmark).select("above_200dma")))
    ready = F.col("available_layer_count") == F.col("layers")
    weaker = F.col("negative_layer_count") == F.col("layers")
    up, down, above = F.col("positive_layer_count"), F.col("negative_layer_count"), F.col("above_200dma")
    strength = F.col("lead.relative_return") - F.col("lag.relative_return")

    def pick(*cases):
        out = F.when(~ready, cases[0])
        for condition, value in cases[1:-1]:
            out = out.when(condition, value)
        return out.otherwise(cases[-1])

    return one.select(
        "as_of",
        F.lit(f"{signal_window}d").alias("signal_window"),
        F.when(~ready | above.isNull(), "unavailable").when(above, "above 200d average").otherwise("below 200d average").alias("benchmark_trend"),
        pick(
            "Unavailable", (weaker & above, "Broad pullback"), (weaker & ~above, "Elevated tail risk"), (weaker, "Broad selloff"),
            ((up > 0) & (down > 0), "Rotation"), (up == F.col("layers"), "Broad advance"), "Mixed",
        ).alias("market_state"),
        pick(
            "insufficient_data", (weaker & above, "broad pullback"), (weaker & ~above, "bear-market selloff"),
            (weaker, "regime unconfirmed"), ((up == 1) & (down > 0), "crowded rotation"), ((up > 0) & (down > 0), "healthy rotation"),
            (up == F.col("layers"), "healthy rotation"), "crowded rotation",
        ).alias("classification"),
        F.when(ready, F.col("lead.layer")).alias("leading_layer"),
        F.when(ready, F.col("lag.layer")).alias("lagging_layer"),
        F.when(ready, strength).alias("rotation_strength"),
        F.when(~ready, "unavailable").when(strength < 0.02, "weak").when(strength < 0.05, "moderate").otherwise("strong").alias("strength_label"),
        up.alias("positive_layer_count"),
        down.alias("negative_layer_count"),
        "available_layer_count",
        (ready & weaker).alias("all_layers_weaker"),
    )
