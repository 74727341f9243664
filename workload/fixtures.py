"""Input tables derived from the provided ones, in Spark.

``sqlparts`` holds the same definitions for the SQL twins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.operators import features as ft
from tickerloom.operators import folds as fo
from tickerloom.operators import labels as lb
from tickerloom.operators import regime as rg

TRAIN, TEST, EMBARGO = 504, 126, 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _priced(daily: DataFrame, key: str, scale: float) -> DataFrame:
    """Turn a daily level into a price: cumulated standardized shocks."""
    whole = Window.partitionBy(key)
    so_far = whole.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    shock = scale * (F.col("level") - F.avg("level").over(whole)) / F.nullif(F.stddev_samp("level").over(whole), F.lit(0.0))
    return daily.withColumn("shock", shock).withColumn("adj_close", 100 * F.exp(F.sum("shock").over(so_far)))


def _ohlc(priced: DataFrame, key: str) -> DataFrame:
    ordered = Window.partitionBy(key).orderBy("date")
    opened = priced.withColumn("open", F.coalesce(F.lag("adj_close").over(ordered), F.col("adj_close")))
    return opened.select(
        key,
        "date",
        "open",
        (F.greatest("open", "adj_close") * (1 + 0.001 * F.col("n_rows"))).alias("high"),
        (F.least("open", "adj_close") * (1 - 0.001 * F.col("n_rows"))).alias("low"),
        F.col("adj_close").alias("close"),
        "adj_close",
        "volume",
    )


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """One ticker per supplier: daily mean unit price of its shipped lines."""
    daily = (
        table(spark, sf, "lineitem")
        .select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
            F.to_date("l_shipdate").alias("date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
            "l_quantity",
        )
        .groupBy("ticker", "date")
        .agg(F.avg("unit").alias("level"), F.sum("l_quantity").alias("volume"), F.count(F.lit(1)).alias("n_rows"))
    )
    return _ohlc(_priced(daily, "ticker", 0.025), "ticker")


def shipping_days(spark: SparkSession, sf: str) -> DataFrame:
    """The calendar of ``bars`` without building them."""
    return table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()


def fold_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return fo.walk_forward(shipping_days(spark, sf), TRAIN, TEST, None, EMBARGO)



def benchmarks(spark: SparkSession, sf: str) -> DataFrame:
    """SPY from daily mean order value, QQQ from daily order count."""
    daily = (
        table(spark, sf, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(F.avg("o_totalprice").alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
        .select("date", F.expr("stack(2, 'SPY', a, 'QQQ', b) AS (symbol, level)"))
    )
    return _priced(daily, "symbol", 0.01).select("symbol", "date", F.col("adj_close").alias("price"))


def baskets(spark: SparkSession, sf: str) -> DataFrame:
    """Layer = region of the supplier."""
    return (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("layer"),
            F.col("n_name").alias("sector"),
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
        )
    )


def earnings(spark: SparkSession, sf: str) -> DataFrame:
    """One report per ticker and quarter: the last order date with a line of the supplier."""
    return (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
            F.date_trunc("quarter", "o_orderdate").alias("quarter"),
        )
        .agg(F.max(F.to_date("o_orderdate")).alias("earnings_date"))
        .select("ticker", "earnings_date")
    )


def technical(spark: SparkSession, sf: str) -> DataFrame:
    return ft.technical(bars(spark, sf), benchmarks(spark, sf))


#: What the regimes read of the trailing columns that window functions give.
REGIME_INPUTS = ("adj_close", "return_60d", "return_120d", "dist_ma_50d", "dist_ma_200d", "volatility_60d", "volume_z_20d", "rs_spy_60d", "rs_qqq_60d")


def featured(
    spark: SparkSession, sf: str, ahead: Callable[[DataFrame], DataFrame] | None = None, keep: Sequence[str] | None = None
) -> DataFrame:
    """Features with regimes.  ``ahead`` adds columns by windows over a ticker, which share the exchange of the features.

    With ``keep`` only these of its columns, and what the regimes read, go on.
    """
    rows = ft.windowed(bars(spark, sf), benchmarks(spark, sf))
    rows = rows if ahead is None else ahead(rows)
    if keep is not None:
        rows = rows.select(*dict.fromkeys(["ticker", "date", *REGIME_INPUTS, *(c for c in keep if c in rows.columns)]))
    return rg.classify(ft.with_worst(rows, medians=True))


def light(spark: SparkSession, sf: str) -> DataFrame:
    """Returns, volatility and aligned benchmarks only: what the labels need."""
    symbols = ["SPY", "QQQ"]
    aligned = ft.join_benchmarks(bars(spark, sf), benchmarks(spark, sf), symbols)
    return ft.combine(aligned, ft.returns_stages(), ft.volatility_stages(), ft.strength_stages(symbols)[:1])


def panel(spark: SparkSession, sf: str, keep: Sequence[str] | None = None) -> DataFrame:
    """Features, regimes and labels; with ``keep`` as in ``featured``."""
    return lb.regime_deterioration(featured(spark, sf, lambda rows: lb.forward_labels(rows, "SPY"), keep))


def _pseudo(labelled: DataFrame) -> DataFrame:
    return labelled.withColumns(
        {
            "p_out": 1 / (1 + F.exp(-20 * F.col("return_20d"))),
            "p_risk": 1 / (1 + F.exp(-10 * (F.col("volatility_20d") - 0.42))),
        }
    )


OUTCOMES = (
    "forward_20d_return",
    "forward_20d_excess_return",
    "forward_20d_drawdown",
)


def scores(spark: SparkSession, sf: str, regimes: bool = False) -> DataFrame:
    """Score panel with closed-form probabilities on walk-forward test rows."""
    if regimes:
        labelled = panel(spark, sf, SCORE_INPUTS)
    else:
        labelled = lb.forward_labels(light(spark, sf), "SPY")
    return scored(spark, sf, labelled, regimes)


#: What ``scored`` reads of a labelled panel with regimes.
SCORE_INPUTS = (
    "ticker", "date", "regime", "return_20d", "return_60d", "volatility_20d", "dist_ma_200d", "label_outperform_20d", "label_drawdown_risk_20d", *OUTCOMES,
    "forward_20d_risk_adjusted_excess_return", "forward_20d_tail_risk_adjusted_excess_return",
)


#: What the prevalence queries read of them; ``scored`` leaves out what is not there.
RATE_INPUTS = ("ticker", "date", "regime", "return_20d", "return_60d", "volatility_20d", "label_outperform_20d", "label_drawdown_risk_20d", "forward_20d_excess_return")


def scored(spark: SparkSession, sf: str, labelled: DataFrame, regimes: bool) -> DataFrame:
    """``scores`` of a labelled panel that is already there."""
    rows = _pseudo(labelled)
    days = shipping_days(spark, sf)
    tested = fo.assign(rows, fo.walk_forward(days, TRAIN, TEST, None, EMBARGO), "test", days)
    outcomes = {
        "forward_20d_return": "forward_return",
        "forward_20d_excess_return": "forward_excess_return",
        "forward_20d_drawdown": "forward_drawdown",
        "forward_20d_risk_adjusted_excess_return": "forward_risk_adjusted",
        "forward_20d_tail_risk_adjusted_excess_return": "forward_tail_adjusted",
    }
    kept = tested.select(
        "fold",
        "date",
        "ticker",
        F.col("label_outperform_20d").alias("actual_out"),
        F.col("p_out").alias("probability_out"),
        F.col("label_drawdown_risk_20d").alias("actual_risk"),
        F.col("p_risk").alias("probability_risk"),
        *[F.col(c).alias(name) for c, name in outcomes.items() if c in labelled.columns],
        "return_60d",
        "volatility_20d",
        *([c for c in ("regime", "dist_ma_200d") if c in labelled.columns] if regimes else []),
    )
    return kept.dropna(
        subset=["actual_out", "probability_out", "actual_risk", "probability_risk"]
    ).withColumn("ml_score", 100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("probability_out"))))


def line_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Seven dense series T1..T7, one per line number."""
    daily = (
        table(spark, sf, "lineitem")
        .select(
            F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("ticker"),
            F.to_date("l_shipdate").alias("date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
            "l_quantity",
        )
        .groupBy("ticker", "date")
        .agg(F.avg("unit").alias("level"), F.sum("l_quantity").alias("volume"), F.count(F.lit(1)).alias("n_rows"))
    )
    return _ohlc(_priced(daily, "ticker", 0.025), "ticker")


def market(spark: SparkSession, sf: str) -> DataFrame:
    """(date, price) over all shipped lines of a date."""
    daily = (
        table(spark, sf, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("date"))
        .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("level"))
        .withColumn("symbol", F.lit("ALL"))
    )
    return _priced(daily, "symbol", 0.01).select("date", F.col("adj_close").alias("price"))


LAYERS = {"T1": "A", "T2": "A", "T3": "B", "T4": "B", "T5": "C", "T6": "D", "T7": "E"}


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """Layer of each line-number series found in lineitem."""
    name = F.concat(F.lit("T"), F.col("l_linenumber").cast("string"))
    pairs = F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv])
    return table(spark, sf, "lineitem").select(name.alias("ticker")).distinct().select(pairs[F.col("ticker")].alias("layer"), "ticker")


def portfolio(spark: SparkSession, sf: str, names: int = 25) -> DataFrame:
    """The names with the largest traded value, in that order (a top-k list)."""
    top = (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey")
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
        .orderBy(F.col("v").desc(), "l_suppkey")
        .limit(names)
    )
    w = Window.orderBy(F.col("v").desc(), "l_suppkey")
    return top.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.row_number().over(w).alias("pos")
    )


def current(spark: SparkSession, sf: str) -> DataFrame:
    """Latest row per ticker with pseudo-scores, last month's weight and action."""
    from tickerloom.operators import allocation as al
    from tickerloom.operators import decision as dc

    rows = _pseudo(featured(spark, sf)).withColumns(
        {"probability_out": F.col("p_out"), "probability_risk": F.col("p_risk"), "ml_score": dc.ml_score(F.col("p_out"))}
    )
    w = Window.partitionBy("ticker").orderBy("date")
    was = al.raw_weight(
        F.lag("ml_score", 20).over(w), F.lag("probability_risk", 20).over(w), F.lag("regime", 20).over(w), al.Limits()
    )
    latest = dc.latest_rows(rows.withColumn("current_weight", was))
    return latest.withColumn("previous_action", al.action(F.lit(0.0), F.col("current_weight")))
