"""Forward-looking outcomes and labels.  Never model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom import fixed
from tickerloom.functions import frames as fr
from tickerloom.functions.stats import over
from tickerloom.plans.ranking import with_positions
from tickerloom.plans.storage import released, settle, stored

VOLATILITY_FLOOR = 1e-6


def as_label(condition: Column, known: Column | None = None) -> Column:
    """0.0 / 1.0, NULL when the inputs are unknown."""
    value = condition.cast("double")
    return value if known is None else F.when(known, value)


def forward_return(price: Column | str, h: int) -> Column:
    return over(F.lead(fr.c(price), h).over(fr.entity()), fr.c(price)) - 1


def forward_drawdown(price: Column | str, h: int) -> Column:
    lowest = F.min(fr.c(price)).over(fr.leading(h))
    return F.when(F.lead(F.lit(1), h).over(fr.entity()).isNotNull(), over(lowest, fr.c(price)) - 1)


def forward_outcomes(aligned: DataFrame, benchmark: str, h: int = 20) -> DataFrame:
    """Return, benchmark return, excess, drawdown and the two adjusted targets."""
    px = f"px_{benchmark.lower()}"
    out = aligned.withColumns(
        {
            f"forward_{h}d_return": forward_return("adj_close", h),
            f"benchmark_forward_{h}d_return": forward_return(px, h),
            f"forward_{h}d_drawdown": forward_drawdown("adj_close", h),
        }
    )
    excess = F.col(f"forward_{h}d_return") - F.col(f"benchmark_forward_{h}d_return")
    loss = -F.least(F.col(f"forward_{h}d_drawdown"), F.lit(0.0))
    known_loss = F.when(F.col(f"forward_{h}d_drawdown").isNotNull(), loss)
    return out.withColumns(
        {
            f"forward_{h}d_excess_return": excess,
            f"forward_{h}d_risk_adjusted_excess_return": excess - 0.5 * known_loss,
            f"forward_{h}d_tail_risk_adjusted_excess_return": excess
            - 0.5 * F.when(known_loss.isNotNull(), F.greatest(known_loss - 0.10, F.lit(0.0))),
        }
    )


def forward_labels(
    aligned: DataFrame, benchmark: str, h: int = 20, outperform: float = 0.02, drawdown: float = -0.10
) -> DataFrame:
    """``aligned`` needs ``adj_close`` and ``px_<benchmark>``; ``regime`` is optional."""
    out = forward_outcomes(aligned, benchmark, h)
    labels = {
        f"label_outperform_{h}d": as_label(F.col(f"forward_{h}d_excess_return") > outperform),
        f"label_risk_adjusted_outperform_{h}d": as_label(
            F.col(f"forward_{h}d_risk_adjusted_excess_return") > outperform
        ),
        f"label_tail_risk_adjusted_outperform_{h}d": as_label(
            F.col(f"forward_{h}d_tail_risk_adjusted_excess_return") > outperform
        ),
        f"label_drawdown_risk_{h}d": as_label(F.col(f"forward_{h}d_drawdown") < drawdown),
    }
    out = out.withColumns(labels)
    return regime_deterioration(out, h) if "regime" in aligned.columns else out


def regime_deterioration(df: DataFrame, h: int = 20) -> DataFrame:
    """Add ``label_regime_deterioration_<h>d``: a weakening or falling regime within the next rows."""
    bad = F.col("regime").isin(fixed.WEAKENING, fixed.DOWNTREND).cast("int")
    label = F.when(F.count(F.lit(1)).over(fr.leading(h)) == h, F.max(bad).over(fr.leading(h)).cast("double"))
    return df.withColumn(f"label_regime_deterioration_{h}d", label)


def top_third_of_date(df: DataFrame, value: str, output: str, minimum: int = 3) -> DataFrame:
    """1.0 for the top third of a date by ``value``, ties broken by ticker.

    ``df`` must be settled: a date may hold any number of tickers, so positions
    come from the shared ordering rather than a window over the date.
    """
    known = df.filter(F.col(value).isNotNull()).select("ticker", "date", value)
    ranked = with_positions(known, "date", value, ["ticker"])
    first = F.min(F.when(F.col("pos") / F.col("group_size") > 2.0 / 3.0, F.struct(F.col(value).alias("v"), F.col("ticker").alias("t"))))
    cuts = ranked.groupBy("date").agg(F.max("group_size").alias("_size"), first.alias("_first"))
    own = F.struct(F.col(value).alias("v"), F.col("ticker").alias("t"))
    flag = F.when(F.col(value).isNotNull() & (F.col("_size") >= minimum), (own >= F.col("_first")).cast("double"))
    return df.join(F.broadcast(settle(cuts)), "date", "left").select("ticker", "date", *[c for c in df.columns if c not in ("ticker", "date")], flag.alias(output))


def target_candidates(features: DataFrame, benchmark: str, h: int = 20, keep: Sequence[str] | None = None) -> DataFrame:
    """Add the alternative targets; needs ``volatility_<h>d`` and ``px_<benchmark>``.

    With ``keep`` only these columns and the key are stored and returned.
    """
    return with_top_tercile(candidate_labels(features, benchmark, h), h, keep)


def candidate_labels(features: DataFrame, benchmark: str, h: int = 20) -> DataFrame:
    """The alternative targets that need a ticker's own rows only."""
    base = forward_labels(forward_labels(features, benchmark, h), benchmark, 60)
    excess, drop = F.col(f"forward_{h}d_excess_return"), F.col(f"forward_{h}d_drawdown")
    vol = F.when(F.abs(F.col(f"volatility_{h}d")) > VOLATILITY_FLOOR, F.col(f"volatility_{h}d"))
    return base.withColumns(
        {
            f"forward_{h}d_recent_vol_adjusted_excess_return": excess / vol,
            f"forward_{h}d_tail_adjusted_score": excess + drop,
        }
    ).withColumns(
        {
            "label_risk_adjusted_excess_20d": as_label(
                F.col(f"forward_{h}d_recent_vol_adjusted_excess_return") > 0
            ),
            "label_tail_adjusted_outperform_20d": as_label(
                F.col(f"forward_{h}d_tail_adjusted_score") > 0.02
            ),
            "label_drawdown_adjusted_opportunity_20d": as_label(
                F.col(f"forward_{h}d_tail_adjusted_score") > 0.02
            ),
            "label_pullback_recovery_20d": as_label(
                (drop <= -0.05) & (excess >= 0), drop.isNotNull() & excess.isNotNull()
            ),
        }
    )


def with_top_tercile(out: DataFrame, h: int = 20, keep: Sequence[str] | None = None) -> DataFrame:
    """``candidate_labels`` with the top third of a date, stored."""
    excess, tercile = f"forward_{h}d_excess_return", "label_top_tercile_excess_20d"
    if keep is None:
        return top_third_of_date(stored(out), excess, tercile)
    needed = list(dict.fromkeys(["ticker", "date", *keep, excess]))
    narrow = released(out.select(*[c for c in needed if c != tercile]))
    return top_third_of_date(narrow, excess, tercile).select(*list(dict.fromkeys(["ticker", "date", *keep])))


def opportunity_variants(labelled: DataFrame, h: int = 20) -> DataFrame:
    excess, drop = F.col(f"forward_{h}d_excess_return"), F.col(f"forward_{h}d_drawdown")
    return labelled.withColumns(
        {
            f"label_stronger_excess_{h}d": as_label(excess > 0.05),
            f"label_composite_opportunity_{h}d": as_label(
                (excess > 0) & (drop >= -0.10), excess.isNotNull() & drop.isNotNull()
            ),
        }
    )


def adverse_outcomes(labelled: DataFrame, h: int = 20) -> DataFrame:
    """Needs ``volatility_20d`` next to the forward outcomes."""
    ret = F.col(f"forward_{h}d_return")
    excess, drop = F.col(f"forward_{h}d_excess_return"), F.col(f"forward_{h}d_drawdown")
    move = F.col("volatility_20d") * F.sqrt(F.lit(h / 252.0))
    known = excess.isNotNull() & drop.isNotNull()
    return labelled.withColumns(
        {
            f"risk_severe_drawdown_{h}d": as_label(drop < -0.15),
            f"risk_negative_excess_{h}d": as_label(excess < -0.05),
            f"risk_composite_drawdown_underperform_{h}d": as_label((drop < -0.10) & (excess < -0.02), known),
            f"risk_vol_adjusted_adverse_{h}d": as_label(
                (ret < -move) | (drop < -move), move.isNotNull() & ret.isNotNull() & drop.isNotNull()
            ),
        }
    )
