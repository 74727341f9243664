"""Rule-based regimes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom import fixed
from tickerloom.functions.trailing import with_trailing
from tickerloom.operators.features import THRESHOLD_MEDIANS


def volatility_threshold(features: DataFrame, causal: bool = False) -> DataFrame:
    """Add ``vol_threshold``: trailing 252-row median of 60-day volatility.

    Rows before the 60th value take the median of the ticker's whole threshold
    series, which looks ahead; ``causal=True`` uses the constant 0.30 instead.
    """
    name = THRESHOLD_MEDIANS[0][0]
    out = features if name in features.columns else with_trailing(features, (), THRESHOLD_MEDIANS, [name])
    fill = F.lit(0.30) if causal else F.coalesce(F.col(f"{name}_typical"), F.lit(0.30))
    return out.withColumn("vol_threshold", F.coalesce(name, fill)).drop(name, f"{name}_typical")


def _value(df: DataFrame, name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def classify(features: DataFrame, use_signals: bool = True, causal: bool = False) -> DataFrame:
    """Add ``regime``, ``regime_rationale`` and ``risk_flags``."""
    df = volatility_threshold(features, causal)
    ret60, ret120 = _value(df, "return_60d"), _value(df, "return_120d")
    dist50, dist200 = _value(df, "dist_ma_50d"), _value(df, "dist_ma_200d")
    vol60, volume = _value(df, "volatility_60d"), _value(df, "volume_z_20d")
    spy, qqq = _value(df, "rs_spy_60d"), _value(df, "rs_qqq_60d")
    entropy = _value(df, "fourier_spectral_entropy", 0.5)
    noise = _value(df, "wavelet_short_noise_intensity")

    wild = (vol60 > F.col("vol_threshold")) | (vol60 > 0.35)
    trend = (ret60 > 0) & (ret120 > 0) & (dist50 > 0) & (dist200 > 0)
    keeps_up = (spy >= -0.02) | (qqq >= -0.02)
    fell = (_value(df, "max_drawdown_60d") < -0.12) | (_value(df, "max_drawdown_120d") < -0.20)
    weak = (ret60 < 0) | (dist50 < 0) | ((volume > 1.5) & (ret60 < 0.03))
    broken = fell & ((ret60 < 0) | (dist200 < 0))

    regime = (
        F.when(broken, fixed.DOWNTREND)
        .when(trend & keeps_up, F.when(wild, fixed.UP_WILD).otherwise(fixed.UP_CALM))
        .when(weak, fixed.WEAKENING)
        .otherwise(fixed.SIDEWAYS)
    )
    # Rationale texts.
    rationale = (
        F.when(broken, "large drawdown with negative trend or below 200d average")
        .when(
            trend & keeps_up,
            "positive 60d/120d trend, above key averages, acceptable relative strength",
        )
        .when(weak, "weakening trend, below 50d average, or negative volume anomaly")
        .otherwise("mixed trend and relative-strength evidence")
    )
    flags = [F.when(fell, "drawdown"), F.when(volume > 2, "volume anomaly")]
    if use_signals:
        flags += [F.when(entropy > 0.8, "diffuse spectrum"), F.when(noise > 0.35, "short-scale noise")]
    return df.withColumns(
        {
            "regime": regime,
            "regime_rationale": rationale,
            "risk_flags": F.array_join(F.array_compact(F.array(*flags)), ", "),
        }
    ).drop("vol_threshold")


def mapped(key: Column, mapping: Mapping[str, float], default: float | None) -> Column:
    """Dictionary lookup with a default, as a literal map."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.create_map(*pairs)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def target_position(regime: Column, mapping: Mapping[str, float] | None = None) -> Column:
    return mapped(regime, mapping or fixed.REGIME_POSITION, 0.0)
