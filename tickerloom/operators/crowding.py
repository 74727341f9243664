"""Correlation and factor crowding of a portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.stats import correlation
from tickerloom.operators.features import daily_return
from tickerloom.plans.storage import settle


def pair_correlation(bars: DataFrame, portfolio: DataFrame, rows: int = 60, minimum: int = 20, high: float = 0.80, moderate: float = 0.50) -> DataFrame:
    """Correlation of the last ``rows`` common daily returns of every portfolio pair.

    ``portfolio`` is ``(ticker, pos)``.  The output itself has one row per pair of
    the list, so the self-join is restricted to the listed names and keyed by
    date; the rest of the universe is dropped by the semi-join first.
    """
    mine = daily_return(bars.join(portfolio, "ticker")).filter(F.col("daily_return").isNotNull())
    a = mine.select("date", F.col("ticker").alias("ticker_a"), F.col("pos").alias("pa"), F.col("daily_return").alias("ra"))
    b = mine.select("date", F.col("ticker").alias("ticker_b"), F.col("pos").alias("pb"), F.col("daily_return").alias("rb"))
    newest = Window.partitionBy("ticker_a", "ticker_b").orderBy(F.col("date").desc())
    recent = a.join(b, (a["date"] == b["date"]) & (F.col("pa") < F.col("pb"))).select(a["date"], "ticker_a", "ticker_b", "ra", "rb")
    recent = recent.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= rows)
    measured = recent.groupBy("ticker_a", "ticker_b").agg(F.count(F.lit(1)).alias("sample_count"), correlation(F.col("ra"), F.col("rb")).alias("corr"))
    left = portfolio.select(F.col("ticker").alias("ticker_a"), F.col("pos").alias("pa"))
    right = portfolio.select(F.col("ticker").alias("ticker_b"), F.col("pos").alias("pb"))
    listed = left.join(right, F.col("pa") < F.col("pb")).select("ticker_a", "ticker_b")
    n = F.coalesce("sample_count", F.lit(0))
    out = listed.join(measured, ["ticker_a", "ticker_b"], "left").select(
        "ticker_a",
        "ticker_b",
        n.alias("sample_count"),
        F.lit(rows).alias("rolling_window_days"),
        F.when(n >= minimum, F.col("corr")).alias("correlation"),
    )
    return out.withColumn(
        "classification",
        F.when(F.col("sample_count") < minimum, "insufficient_sample")
        .when(F.col("correlation") >= high, "high_overlap")
        .when(F.col("correlation") >= moderate, "moderate_overlap")
        .otherwise("diversifying"),
    )


def components(edges: DataFrame) -> DataFrame:
    """``(ticker, cluster)`` by min-label propagation until nothing changes.

    Labels shrink to the smallest name of the neighbourhood and then jump to the
    label's own label, so long chains settle in a logarithmic number of rounds.
    Each round is cut by a checkpoint.
    """
    both = settle(
        edges.select(F.col("ticker_a").alias("u"), F.col("ticker_b").alias("v"))
        .unionByName(edges.select(F.col("ticker_b").alias("u"), F.col("ticker_a").alias("v")))
        .distinct()
    )
    labels = settle(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("c").alias("nc")), "v").groupBy("u").agg(F.min("nc").alias("nc"))
        stepped = labels.join(near, "u").select("u", F.least("c", "nc").alias("c"), F.col("c").alias("was"))
        jump = labels.select(F.col("u").alias("c"), F.col("c").alias("cc"))
        moved = settle(stepped.join(jump, "c", "left").select("u", F.least("c", F.coalesce("cc", "c")).alias("c"), "was"))
        changed = moved.filter(F.col("c") != F.col("was")).limit(1).count()
        labels = moved.select("u", "c")
        if not changed:
            return labels.select(F.col("u").alias("ticker"), F.col("c").alias("cluster"))


def summary(pairs: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Mean and max correlation, high pairs, largest cluster, class."""
    pairs = settle(pairs)
    groups = components(pairs.filter(F.col("classification") == "high_overlap"))
    largest = groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest_cluster_size"))
    known = F.col("correlation").isNotNull()
    stats = pairs.agg(
        F.count(F.lit(1)).alias("_pairs"),
        F.coalesce(F.min(F.when(known, F.col("sample_count"))), F.lit(0)).alias("sample_count"),
        F.count_if(F.col("classification") == "high_overlap").alias("high_overlap_pair_count"),
        F.avg("correlation").alias("average_pairwise_correlation"),
        F.max("correlation").alias("max_pairwise_correlation"),
    )
    count = portfolio.agg(F.count(F.lit(1)).alias("ticker_count"))
    n, high, mean = F.col("ticker_count"), F.col("high_overlap_pair_count"), F.col("average_pairwise_correlation")
    crowded = (mean >= 0.65) | (F.col("largest_cluster_size") >= F.ceil(n * 0.5)) | (high >= F.greatest(F.lit(2), F.ceil(n / 3)))
    return (
        stats.crossJoin(F.broadcast(largest))
        .crossJoin(F.broadcast(count))
        .select(
            F.lit("portfolio_correlation_crowding").alias("diagnostic"),
            "ticker_count",
            "sample_count",
            "high_overlap_pair_count",
            "average_pairwise_correlation",
            "max_pairwise_correlation",
            "largest_cluster_size",
            F.when(n < 2, "unavailable")
            .when(mean.isNull(), F.when(F.col("_pairs") > 0, "insufficient_sample").otherwise("unavailable"))
            .when(crowded, "high_crowding")
            .when((mean >= 0.45) | (high > 0), "moderate_crowding")
            .otherwise("low_crowding")
            .alias("classification"),
        )
    )


def factor_exposure(portfolio: DataFrame, proxies: DataFrame) -> DataFrame:
    """``proxies`` is ``(ticker, proxy_group, classification)``; unmapped names read unknown."""
    kind = F.coalesce("classification", F.lit("unknown"))
    return portfolio.select("ticker", "pos").join(proxies, "ticker", "left").select(
        "ticker",
        "pos",
        F.coalesce("proxy_group", F.lit("unknown")).alias("proxy_group"),
        F.when(kind == "mapped", "static_ticker_proxy").when(kind == "proxy_only", "static_etf_proxy").otherwise("unmapped").alias("proxy_source"),
        kind.alias("classification"),
    )


def factor_crowding(exposure: DataFrame) -> DataFrame:
    total = exposure.agg(F.count(F.lit(1)).alias("_total"))
    groups = exposure.groupBy("proxy_group").agg(
        F.count(F.lit(1)).alias("ticker_count"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ticker"))), lambda s: s["ticker"]), ",").alias("tickers"),
        F.bool_or(F.col("classification") == "proxy_only").alias("_etf"),
        F.bool_or(F.col("classification") == "mapped").alias("_single"),
    )
    share = F.col("ticker_count") / F.col("_total")
    return groups.crossJoin(F.broadcast(total)).select(
        "proxy_group",
        "ticker_count",
        "tickers",
        F.when(F.col("proxy_group") == "unknown", "unknown")
        .when((share >= 0.40) | (F.col("_etf") & F.col("_single")), "crowded")
        .when(share >= 0.25, "watch")
        .otherwise("low")
        .alias("classification"),
    )
