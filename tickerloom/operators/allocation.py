"""Score-driven target weights and table-shaped portfolio accounting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom import fixed
from tickerloom.functions.stats import over
from tickerloom.operators.backtest import performance
from tickerloom.operators.regime import mapped


@dataclass(frozen=True)
class Limits:
    """Default guardrails."""

    max_position: float = 0.12
    min_position: float = 0.01
    cash_floor: float = 0.10
    max_gross: float = 0.90
    high_risk: float = 0.60
    moderate_risk: float = 0.40
    volatility_target: float | None = None

    @property
    def cap(self) -> float:
        return min(self.max_gross, 1.0 - self.cash_floor)


# Named profiles (cash floor, max position, high risk, moderate risk).
PROFILES = {
    "Conservative": Limits(max_position=0.08, cash_floor=0.20, max_gross=0.80, high_risk=0.50, moderate_risk=0.35),
    "Balanced": Limits(),
    "Aggressive": Limits(max_position=0.16, cash_floor=0.05, max_gross=0.95, high_risk=0.70, moderate_risk=0.50),
}


def score_multiplier(score: Column) -> Column:
    """Bands include both ends; the higher band wins at a boundary."""
    return (
        F.when(score.between(80, 100), 1.0)
        .when(score.between(60, 80), 0.75)
        .when(score.between(40, 60), 0.5)
        .when(score.between(20, 40), 0.25)
        .otherwise(0.0)
    )


def volatility_scale(volatility: Column, target: float) -> Column:
    return F.least(F.lit(1.0), over(F.lit(target), volatility))


def raw_weight(score: Column, risk: Column, regime: Column, limits: Limits, volatility: Column | None = None) -> Column:
    """Target before the exposure cap.

    A drawdown probability of exactly 0 counts as unknown, that is 1.
    """
    p = F.when(F.coalesce(risk, F.lit(1.0)) == 0, 1.0).otherwise(F.coalesce(risk, F.lit(1.0)))
    m = score_multiplier(F.coalesce(score, F.lit(0.0)))
    m = F.when(p >= limits.high_risk, 0.0).when(p >= limits.moderate_risk, m * 0.5).otherwise(m)
    m = m * mapped(regime, fixed.REGIME_MULTIPLIER, fixed.UNKNOWN_REGIME_MULTIPLIER)
    if limits.volatility_target and volatility is not None:
        m = m * F.when(volatility > 0, volatility_scale(volatility, limits.volatility_target)).otherwise(1.0)
    target = F.lit(limits.max_position) * m
    return F.when((target > 0) & (target < limits.min_position), 0.0).otherwise(target)


def action(current: Column, target: Column, minimum: float = 0.01) -> Column:
    return (
        F.when((target <= 0) & (current > minimum), "Exit")
        .when(target <= 0, "Watch")
        .when((current <= minimum) & (target > minimum), "Add")
        .when(target > current + minimum, "Add")
        .when(target < current - minimum, "Trim")
        .otherwise("Hold")
    )


def _share_of(totals: DataFrame, by: Sequence[str], df: DataFrame) -> DataFrame:
    """Attach per-group totals; a group may be the whole universe of one date."""
    if not by:
        return df.crossJoin(F.broadcast(totals))
    return df.join(F.broadcast(totals) if len(by) == 1 else totals, list(by))  # of one key: a row per date


def allocate(scores: DataFrame, limits: Limits | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Add ``raw_target_weight``, ``target_weight``, ``suggested_action``.

    ``by`` names the decision date; its total exposure is pre-aggregated and
    joined back (one row per date) instead of being windowed over the date.
    """
    limits = limits or Limits()
    vol = F.col("volatility_60d") if "volatility_60d" in scores.columns else None
    risk = F.col("probability_risk")
    raw = raw_weight(F.col("ml_score"), risk, F.col("regime"), limits, vol)
    out = scores.withColumn("raw_target_weight", raw)
    if "current_weight" not in out.columns:
        out = out.withColumn("current_weight", F.lit(0.0))
    gross = out.groupBy(*by).agg(F.sum("raw_target_weight").alias("_gross"))
    scale = F.when(F.col("_gross") > limits.cap, F.lit(limits.cap) / F.col("_gross")).otherwise(1.0)
    out = (
        _share_of(gross, by, out)
        .withColumn("_scale", scale)
        .withColumn("target_weight", F.col("raw_target_weight") * F.col("_scale"))
        .withColumn("suggested_action", action(F.coalesce("current_weight", F.lit(0.0)), F.col("target_weight"), limits.min_position))
    )
    multiplier = mapped(F.col("regime"), fixed.REGIME_MULTIPLIER, fixed.UNKNOWN_REGIME_MULTIPLIER)
    parts = [
        F.concat(F.lit("score "), F.round(F.coalesce("ml_score", F.lit(0.0))).cast("long").cast("string")),
        F.when(risk >= limits.high_risk, "high drawdown risk").when(risk >= limits.moderate_risk, "moderate drawdown risk"),
        F.concat(F.lit("regime multiplier "), F.format_string("%.2f", multiplier)),
        *([] if vol is None or not limits.volatility_target else [F.when(vol > 0, F.format_string("volatility adjustment %.2f", volatility_scale(vol, limits.volatility_target)))]),
        F.when(F.col("_scale") < 1, F.format_string("scaled to exposure cap %d%%", F.lit(round(limits.cap * 100)))),
    ]
    return out.withColumn(
        "allocation_explanation", F.concat(F.col("ticker"), F.lit(": "), F.concat_ws("; ", *parts))
    ).drop("_gross", "_scale")


def rebalance_dates(days: DataFrame, frequency: str = "weekly") -> DataFrame:
    """Last trading date of each ISO week or month."""
    unit = {"weekly": "week", "monthly": "month"}[frequency]
    return days.groupBy(F.date_trunc(unit, "date").alias("_p")).agg(F.max("date").alias("rebalance_date")).drop("_p")


def latest_scores_at(scores: DataFrame, rebalances: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each ticker's latest score row on or before every rebalance date, for each ``by``.

    Score dates are first mapped to the next rebalance (calendar-sized lookup),
    reduced to one row per ticker and rebalance, and then carried forward to the
    rebalances where nothing newer arrived.  Nothing is range-joined at row level.
    """
    dates = scores.select("date").distinct()
    due = (
        dates.join(F.broadcast(rebalances), F.col("rebalance_date") >= F.col("date"))
        .groupBy("date")
        .agg(F.min("rebalance_date").alias("first_due"))
    )
    keys = [*by, "ticker"]
    payload = [c for c in scores.columns if c not in keys]
    newest = (
        scores.join(F.broadcast(due), "date")
        .groupBy(*keys, "first_due")
        .agg(F.max_by(F.struct(*payload), "date").alias("s"))
    )
    following = F.lead("first_due").over(Window.partitionBy(*keys).orderBy("first_due"))
    calendar = rebalances.agg(F.sort_array(F.collect_list("rebalance_date")).alias("_all"))
    span = F.filter(
        F.col("_all"), lambda d: (d >= F.col("first_due")) & (F.col("_next").isNull() | (d < F.col("_next")))
    )
    flat = newest.select(*keys, "first_due", *[F.col(f"s.{c}").alias(c) for c in payload])
    return (
        flat.withColumn("_next", following)
        .crossJoin(F.broadcast(calendar))
        .withColumn("rebalance_date", F.explode(span))
        .drop("_all", "_next", "first_due")
    )


def guardrails(
    weights: DataFrame, downtrend: Column, drawdown: Column, limits: Limits | None = None,
    limit: float = -0.15, by: str = "rebalance_date",
) -> DataFrame:
    """De-risk in benchmark downtrends and deep drawdowns, then cap gross exposure.

    Targets that were scaled to the cap add up to it within a rounding error, which
    depends on the order of the sum and is no excess.
    """
    limits = limits or Limits()
    weak, deep = F.coalesce(downtrend, F.lit(False)), F.coalesce(drawdown <= limit, F.lit(False))
    cut = F.greatest(F.col("target_weight"), F.lit(0.0)) * F.when(weak, 0.5).otherwise(1.0) * F.when(deep, 0.5).otherwise(1.0)
    out = weights.withColumns({"_cut": cut, "_weak": weak, "_deep": deep})
    gross = out.groupBy(by).agg(F.sum("_cut").alias("_gross"))
    capped = F.round("_gross", 9) > limits.cap
    flags = F.array(
        F.when(F.col("_weak"), "benchmark downtrend de-risking"),
        F.when(F.col("_deep"), "portfolio drawdown de-risking"),
        F.when(capped, "gross exposure cap"),
    )
    return (
        out.join(F.broadcast(gross), by)
        .withColumn("adjusted_weight", F.col("_cut") * F.when(capped, limits.cap / F.col("_gross")).otherwise(1.0))
        .withColumn("risk_control_flags", F.array_join(F.array_compact(flags), ", "))
        .drop("_cut", "_weak", "_deep", "_gross")
    )


def is_downtrend(regime: Column, dist200: Column, ret60: Column) -> Column:
    return (
        F.coalesce(regime.contains("Downtrend"), F.lit(False))
        | F.coalesce(dist200 < 0, F.lit(False))
        | F.coalesce(ret60 < 0, F.lit(False))
    )


def held_weights(days: DataFrame, weights: DataFrame, lag: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Calendar of ``(date, rebalance_date)``, for each ``by``: the rebalance in force ``lag`` dates earlier.

    Windows hold the calendar and the rebalances of one case.
    """
    by = list(by)
    rebalances = weights.select(*by, F.col("rebalance_date").alias("date")).distinct()
    every = days.select("date").distinct()
    every = every.crossJoin(F.broadcast(rebalances.select(*by).distinct())) if by else every
    marks = every.withColumn("rebalance_date", F.lit(None).cast("date")).unionByName(rebalances.withColumn("rebalance_date", F.col("date").cast("date")))
    before = Window.partitionBy(*by).orderBy("date", F.col("rebalance_date").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    held = marks.withColumn("_held", F.last("rebalance_date", ignorenulls=True).over(before)).filter("rebalance_date IS NULL")
    held = held.select(*by, "date", F.col("_held").alias("rebalance_date"))
    if lag == 1:
        return held
    return held.withColumn("rebalance_date", F.lag("rebalance_date", lag - 1).over(Window.partitionBy(*by).orderBy("date")))


def positions(bars: DataFrame, days: DataFrame, weights: DataFrame, lag: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Weight in force next to each bar's return, for each ``by``; missing weights are 0."""
    returns = bars.select(
        "ticker",
        "date",
        F.coalesce(
            over(F.col("adj_close"), F.lag("adj_close").over(Window.partitionBy("ticker").orderBy("date"))) - 1, F.lit(0.0)
        ).alias("r"),
    )
    held = held_weights(days, weights, lag, by)
    held = returns.join(held if by else F.broadcast(held), "date", "inner" if by else "left")
    w = weights.select(*by, "ticker", "rebalance_date", "weight")
    return held.join(w, [*by, "ticker", "rebalance_date"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def contribution(position_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    part = F.col("weight") * F.col("r")
    return position_rows.groupBy(*by, "ticker").agg(
        F.sum(part).alias("return_contribution"),
        F.sum(F.when(part < 0, part).otherwise(0.0)).alias("downside_contribution"),
    )


def rebalance_stats(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gross exposure, holdings and turnover against the previous rebalance, for each ``by``."""
    at = [*by, "rebalance_date"]
    calendar = weights.select(*at).distinct()
    previous = calendar.select(
        *at, F.lag("rebalance_date").over(Window.partitionBy(*by).orderBy("rebalance_date")).alias("previous")
    )
    now = weights.select("ticker", *at, "weight")
    following = previous.filter("previous IS NOT NULL").select(
        *by, F.col("previous").alias("rebalance_date"), F.col("rebalance_date").alias("next_date")
    )
    carried = now.join(following if by else F.broadcast(following), at).select(
        "ticker", *by, F.col("next_date").alias("rebalance_date"), F.lit(0.0).alias("weight"), F.col("weight").alias("was")
    )
    both = (
        now.withColumn("was", F.lit(0.0)).unionByName(carried)
        .groupBy("ticker", *at).agg(F.sum("weight").alias("weight"), F.sum("was").alias("was"))
    )
    return both.groupBy(*at).agg(
        F.sum("weight").alias("gross_exposure"),
        F.count_if(F.col("weight") > 0).alias("holdings"),
        F.sum(F.abs(F.col("weight") - F.col("was"))).alias("traded"),
    )


def exposure_curve(bars: DataFrame, days: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gross return, exposure, holdings and turnover by calendar date, for each ``by``."""
    by = list(by)
    held = held_weights(days, weights, by=by)
    gains = positions(bars, days, weights, by=by).groupBy(*by, "date").agg(F.sum(F.col("weight") * F.col("r")).alias("gross_return"))
    stats = rebalance_stats(weights, by)
    w = Window.partitionBy(*by).orderBy("date")
    changed = ~F.col("rebalance_date").eqNullSafe(F.lag("rebalance_date").over(w))
    return (
        held.join(stats if by else F.broadcast(stats), [*by, "rebalance_date"], "left")
        .join(gains if by else F.broadcast(gains), [*by, "date"], "left")
        .withColumns(
            {
                "gross_return": F.coalesce("gross_return", F.lit(0.0)),
                "gross_exposure": F.coalesce("gross_exposure", F.lit(0.0)),
                "holdings": F.coalesce("holdings", F.lit(0)),
                "turnover": F.when(changed, F.coalesce("traded", F.lit(0.0))).otherwise(0.0),
            }
        )
        .drop("traded")
    )


def net_curve(curve: DataFrame, cost_bps: float | Column, capital: float = 100000.0, by: Sequence[str] = ()) -> DataFrame:
    """Adds costs, net return, cash and equity to an exposure curve; a window holds one case's calendar."""
    upto = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        curve.withColumn("trading_cost", F.col("turnover") * (cost_bps / 10000.0))
        .withColumn("portfolio_return", F.col("gross_return") - F.col("trading_cost"))
        .withColumn("cash", 1 - F.col("gross_exposure"))
        .withColumn("portfolio_equity", capital * F.product(1 + F.col("portfolio_return")).over(upto))
    )


def portfolio_curve(bars: DataFrame, days: DataFrame, weights: DataFrame, cost_bps: float = 7.0, capital: float = 100000.0) -> DataFrame:
    """One row per calendar date; windows run over the aggregated calendar only."""
    return net_curve(exposure_curve(bars, days, weights), cost_bps, capital)


def portfolio_summary(curve: DataFrame, contributions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Portfolio metrics, one row for each ``by``; contributions may be the same for several of them."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    fields = performance(F.col("portfolio_return"), F.col("_dd"))
    fields["hit_rate"] = fields.pop("win_rate")
    fields |= {
        "turnover": F.sum("turnover"),
        "average_cash": F.avg("cash"),
        "average_exposure": F.avg("gross_exposure"),
        "average_holdings": F.avg("holdings"),
    }
    shared = [c for c in by if c in contributions.columns]
    top = contributions.groupBy(*shared).agg(F.max_by("ticker", F.struct("return_contribution", "ticker")).alias("top_contributor"))
    return (
        curve.withColumn("_dd", F.col("portfolio_equity") / F.max("portfolio_equity").over(w) - 1)
        .groupBy(*by)
        .agg(*[v.alias(k) for k, v in fields.items()])
        .withColumn("calmar", F.col("cagr") / F.nullif(F.abs("max_drawdown"), F.lit(0.0)))
        .transform(lambda rows: rows.join(top, shared, "left") if shared else rows.crossJoin(F.broadcast(top)))
    )
