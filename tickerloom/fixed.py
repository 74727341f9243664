"""Names, labels and thresholds every result depends on."""

from __future__ import annotations

# OHLCV field spellings accepted in file headers.
FIELD_ALIASES = {
    "date": "date",
    "open": "open",
    "high": "high",
    "low": "low",
    "close": "close",
    "adj close": "adj_close",
    "adjclose": "adj_close",
    "adjusted close": "adj_close",
    "volume": "volume",
}
PRICE_FIELDS = ("open", "high", "low", "close", "adj_close", "volume")

# Regime names, best to worst.
UP_CALM = "Uptrend / low volatility"
UP_WILD = "Uptrend / high volatility"
SIDEWAYS = "Sideways / low conviction"
WEAKENING = "Distribution / weakening trend"
DOWNTREND = "Downtrend / high risk"
REGIMES = (UP_CALM, UP_WILD, SIDEWAYS, WEAKENING, DOWNTREND)

# Regime -> target position, regime -> allocation multiplier.
REGIME_POSITION = {UP_CALM: 1.0, UP_WILD: 1.0, SIDEWAYS: 0.25, WEAKENING: 0.0, DOWNTREND: 0.0}
REGIME_MULTIPLIER = {UP_CALM: 1.0, UP_WILD: 0.85, SIDEWAYS: 0.5, WEAKENING: 0.25, DOWNTREND: 0.0}
UNKNOWN_REGIME_MULTIPLIER = 0.5

# Columns never offered to a model.
NOT_FEATURES = (
    "daily_return",
    "return_5d",
    "return_120d",
    "rs_spy_120d",
    "rs_qqq_120d",
    "fourier_freq_1",
    "fourier_period_1",
    "fourier_freq_2",
    "fourier_period_2",
    "fourier_amp_2",
    "fourier_freq_3",
    "fourier_period_3",
    "fourier_amp_3",
    "wavelet_available",
    "wavelet_energy_scale_2",
    "wavelet_energy_scale_3",
)
TECHNICAL_PREFIXES = (
    "daily_return",
    "return_",
    "volatility_",
    "max_drawdown_",
    "dist_ma_",
    "volume_z_",
    "rsi_",
    "rs_",
)

# Earnings report timing vocabulary.
REPORT_TIMING = ("before_open", "after_close", "during_market", "")


# Points of the candidate ranking.
QUALITY_POINTS = {"Promising": 3.0, "Mixed": 2.0, "Weak": 1.0, "Unusable": 0.0}
STATUS_POINTS = {
    "Candidate for production trial": 4.0,
    "Keep baseline": 3.0,
    "Special setup only": 2.0,
    "Research-only candidate": 1.5,
    "Insufficient evidence": 0.5,
    "Reject for now": 0.0,
}
CALIBRATION_POINTS = {"Good": 2.0, "Acceptable": 1.0, "Unavailable": 0.5, "Poor": 0.0}
STABILITY_POINTS = {"Stable across regimes": 2.0, "Regime-sensitive": 1.0, "Insufficient data": 0.5, "Inverted in some regimes": 0.0}
GROUP_POINTS = {"Stable across feature groups": 2.0, "Feature-group dependent": 1.0, "Insufficient data": 0.5, "Weak across feature groups": 0.0}

# Evidence labels, the first present one stands for its area, and what they mean.
EVIDENCE_PRIORITY = (
    "harmful", "inverted", "not_ready", "risky", "likely_overfit", "unstable", "high_crowding", "high_overlap", "crowded", "watch", "mixed",
    "moderate_crowding", "insufficient_data", "insufficient_sample", "insufficient_event_data", "unavailable", "promising", "useful", "reliable",
    "stable", "clean", "low_risk", "low", "low_crowding",
)
EVIDENCE_STRENGTH = {
    "harmful": ("harmful", "inverted", "not_ready", "risky", "likely_overfit", "unstable", "high_crowding", "high_overlap", "crowded"),
    "mixed": ("watch", "mixed", "moderate_crowding", "promising"),
    "unavailable": ("unavailable", "insufficient_data", "insufficient_sample", "insufficient_event_data"),
    "useful": ("useful", "reliable", "stable", "clean", "low_risk", "low", "low_crowding"),
}

# What may change between two runs without being material.
RUN_TOLERANCE = {"auc": 0.005, "brier": 0.02, "gap": 0.03, "spread": 0.005}

# Candidates of a role, in the order in which an available one is taken.
REGIME_COLUMNS = ("market_regime", "regime", "trend_regime", "risk_regime", "volatility_regime", "drawdown_regime")
MOMENTUM_COLUMNS = ("momentum_60d", "rs_qqq_60d", "rs_spy_60d", "momentum_20d", "rs_qqq_120d", "rs_spy_120d")
OUTCOME_COLUMNS = ("forward_20d_excess_return", "forward_20d_return")
