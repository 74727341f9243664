"""Trailing features, regimes and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import features as ft
from tickerloom.operators import labels as lb
from tickerloom.operators import regime as rg
from tickerloom.operators import transforms as tr
from workload import fixtures as fx
from workload import sqlparts as sp
from workload.registry import query, rs, shown

KEY = "ticker, date, "


@query("bars_normalized", sp.with_(sp.BARS, f"SELECT {KEY}{rs('open, high, low, close, adj_close, volume')} FROM bars"))
def bars_normalized(spark, sf):
    return shown(fx.bars(spark, sf))


@query("trailing_returns", sp.with_(sp.ALIGNED, f"SELECT {KEY}{rs('daily_return, return_5d, return_20d, return_60d, return_120d')} FROM light"))
def trailing_returns(spark, sf):
    df = ft.trailing_returns(ft.daily_return(fx.bars(spark, sf)))
    return shown(df, "ticker", "date", "daily_return", "return_5d", "return_20d", "return_60d", "return_120d")


@query("rolling_volatility", sp.with_(sp.ALIGNED, f"SELECT {KEY}{rs('volatility_20d, volatility_60d')} FROM light"))
def rolling_volatility(spark, sf):
    return shown(ft.volatility(fx.bars(spark, sf)), "ticker", "date", "volatility_20d", "volatility_60d")


@query(
    "rolling_drawdown",
    sp.with_(sp.BARS + "," + sp.drops("bars"), f"SELECT {KEY}{rs('max_drawdown_60d, max_drawdown_120d')} FROM drops"),
)
def rolling_drawdown(spark, sf):
    return shown(ft.drawdowns(fx.bars(spark, sf)), "ticker", "date", "max_drawdown_60d", "max_drawdown_120d")


@query("ma_distance", sp.with_(sp.TECHNICAL, f"SELECT {KEY}{rs('ma_50d, ma_200d, dist_ma_50d, dist_ma_200d')} FROM technical"))
def ma_distance(spark, sf):
    return shown(ft.moving_averages(fx.bars(spark, sf)), "ticker", "date", "ma_50d", "ma_200d", "dist_ma_50d", "dist_ma_200d")


@query("rsi", sp.with_(sp.TECHNICAL, f"SELECT {KEY}{rs('rsi_14d')} FROM technical"))
def rsi(spark, sf):
    return shown(ft.rsi(fx.bars(spark, sf)), "ticker", "date", "rsi_14d")


@query("volume_z", sp.with_(sp.TECHNICAL, f"SELECT {KEY}{rs('volume_z_20d, volume_z_60d')} FROM technical"))
def volume_z(spark, sf):
    return shown(ft.volume_z(fx.bars(spark, sf)), "ticker", "date", "volume_z_20d", "volume_z_60d")


@query(
    "relative_strength",
    sp.with_(sp.TECHNICAL, f"SELECT {KEY}{rs('px_spy, px_qqq, rs_spy_60d, rs_spy_120d, rs_qqq_60d, rs_qqq_120d')} FROM technical"),
)
def relative_strength(spark, sf):
    df = ft.relative_strength(fx.bars(spark, sf), fx.benchmarks(spark, sf), ["SPY", "QQQ"])
    return shown(df, "ticker", "date", "px_spy", "px_qqq", "rs_spy_60d", "rs_spy_120d", "rs_qqq_60d", "rs_qqq_120d")


@query("regimes", sp.with_(sp.FEATURED, "SELECT ticker, date, regime, risk_flags FROM featured"))
def regimes(spark, sf):
    return fx.featured(spark, sf).select("ticker", "date", "regime", "risk_flags")


@query("regime_counts", sp.with_(sp.FEATURED, "SELECT regime, count(*) AS n, count(DISTINCT ticker) AS tickers FROM featured GROUP BY regime"))
def regime_counts(spark, sf):
    return fx.featured(spark, sf).groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"))


FORWARD = (
    "forward_20d_return, benchmark_forward_20d_return, forward_20d_excess_return, forward_20d_drawdown, "
    "forward_20d_risk_adjusted_excess_return, forward_20d_tail_risk_adjusted_excess_return, label_outperform_20d, "
    "label_risk_adjusted_outperform_20d, label_tail_risk_adjusted_outperform_20d, label_drawdown_risk_20d"
)


@query("forward_labels", sp.with_(sp.LABELLED, f"SELECT {KEY}{rs(FORWARD)} FROM labelled"))
def forward_labels(spark, sf):
    aligned = ft.with_benchmarks(fx.bars(spark, sf), fx.benchmarks(spark, sf), ["SPY"])
    return shown(lb.forward_labels(aligned, "SPY"), "ticker", "date", *FORWARD.split(", "))


@query(
    "regime_deterioration",
    sp.with_(
        sp.FEATURED,
        f"""SELECT ticker, date, CASE WHEN count(*) OVER n = 20 THEN
  CAST(max(CASE WHEN regime IN ('{rg.fixed.WEAKENING}', '{rg.fixed.DOWNTREND}') THEN 1 ELSE 0 END) OVER n AS DOUBLE) END
  AS label_regime_deterioration_20d FROM featured
  WINDOW n AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)""",
    ),
)
def regime_deterioration(spark, sf):
    return shown(fx.panel(spark, sf), "ticker", "date", "label_regime_deterioration_20d")


ADVERSE = (
    "risk_severe_drawdown_20d, risk_negative_excess_20d, risk_composite_drawdown_underperform_20d, "
    "risk_vol_adjusted_adverse_20d, label_stronger_excess_20d, label_composite_opportunity_20d"
)
ADVERSE_SQL = sp.LABELLED + """,
adverse AS MATERIALIZED (SELECT *, CAST(forward_20d_drawdown < -0.15 AS DOUBLE) AS risk_severe_drawdown_20d,
  CAST(forward_20d_excess_return < -0.05 AS DOUBLE) AS risk_negative_excess_20d,
  CASE WHEN forward_20d_drawdown IS NOT NULL AND forward_20d_excess_return IS NOT NULL THEN
    CAST(forward_20d_drawdown < -0.10 AND forward_20d_excess_return < -0.02 AS DOUBLE) END AS risk_composite_drawdown_underperform_20d,
  CASE WHEN volatility_20d IS NOT NULL AND forward_20d_return IS NOT NULL AND forward_20d_drawdown IS NOT NULL THEN
    CAST(forward_20d_return < -volatility_20d * sqrt(20 / 252.0) OR forward_20d_drawdown < -volatility_20d * sqrt(20 / 252.0) AS DOUBLE) END
    AS risk_vol_adjusted_adverse_20d,
  CAST(forward_20d_excess_return > 0.05 AS DOUBLE) AS label_stronger_excess_20d,
  CASE WHEN forward_20d_drawdown IS NOT NULL AND forward_20d_excess_return IS NOT NULL THEN
    CAST(forward_20d_excess_return > 0 AND forward_20d_drawdown >= -0.10 AS DOUBLE) END AS label_composite_opportunity_20d
  FROM labelled)"""


@query("adverse_labels", sp.with_(ADVERSE_SQL, f"SELECT {KEY}{rs(ADVERSE)} FROM adverse"))
def adverse_labels(spark, sf):
    out = lb.opportunity_variants(lb.adverse_outcomes(lb.forward_outcomes(fx.light(spark, sf), "SPY")))
    return shown(out, "ticker", "date", *ADVERSE.split(", "))


TARGETS = (
    "forward_60d_excess_return, forward_20d_recent_vol_adjusted_excess_return, forward_20d_tail_adjusted_score, "
    "label_outperform_60d, label_risk_adjusted_excess_20d, label_tail_adjusted_outperform_20d, "
    "label_drawdown_adjusted_opportunity_20d, label_pullback_recovery_20d, label_top_tercile_excess_20d"
)
TARGET_SQL = sp.LABELLED + "," + sp.labelled("labelled", "labelled60", 60) + """,
tgt_a AS (SELECT *, forward_20d_excess_return / CASE WHEN abs(volatility_20d) > 1e-6 THEN volatility_20d END
    AS forward_20d_recent_vol_adjusted_excess_return,
    forward_20d_excess_return + forward_20d_drawdown AS forward_20d_tail_adjusted_score,
    CASE WHEN forward_20d_excess_return IS NOT NULL THEN row_number() OVER (PARTITION BY date, forward_20d_excess_return IS NULL
      ORDER BY forward_20d_excess_return, ticker) END AS pos,
    count(forward_20d_excess_return) OVER (PARTITION BY date) AS n FROM labelled60),
targets AS MATERIALIZED (SELECT *, CAST(forward_20d_recent_vol_adjusted_excess_return > 0 AS DOUBLE) AS label_risk_adjusted_excess_20d,
    CAST(forward_20d_tail_adjusted_score > 0.02 AS DOUBLE) AS label_tail_adjusted_outperform_20d,
    CAST(forward_20d_tail_adjusted_score > 0.02 AS DOUBLE) AS label_drawdown_adjusted_opportunity_20d,
    CASE WHEN forward_20d_excess_return IS NOT NULL AND forward_20d_drawdown IS NOT NULL THEN
      CAST(forward_20d_drawdown <= -0.05 AND forward_20d_excess_return >= 0 AS DOUBLE) END AS label_pullback_recovery_20d,
    CASE WHEN n >= 3 AND pos IS NOT NULL THEN CAST(CAST(pos AS DOUBLE) / n > 2.0 / 3.0 AS DOUBLE) END AS label_top_tercile_excess_20d FROM tgt_a)"""


@query("target_labels", sp.with_(TARGET_SQL, f"SELECT {KEY}{rs(TARGETS)} FROM targets"))
def target_labels(spark, sf):
    return shown(lb.target_candidates(fx.light(spark, sf), "SPY"), "ticker", "date", *TARGETS.split(", "))


# The transform is checked against trigonometric sums: power of bin k of a demeaned 60-row window.
FOURIER_SQL = sp.ALIGNED + """,
dft_n AS MATERIALIZED (SELECT ticker, date, daily_return AS x, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM light),
dft_w AS (SELECT a.ticker, a.date, b.rn - a.rn + 59 AS t, b.x - avg(b.x) OVER (PARTITION BY a.ticker, a.rn) AS x
          FROM dft_n a JOIN dft_n b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn - 59 AND a.rn WHERE a.rn > 60),
dft_k AS (SELECT unnest(range(1, 31)) AS k),
dft_b AS MATERIALIZED (SELECT k, unnest(range(0, 60)) AS t, cos(2 * pi() * k * unnest(range(0, 60)) / 60) AS c,
          sin(2 * pi() * k * unnest(range(0, 60)) / 60) AS s FROM dft_k),
dft_p AS MATERIALIZED (SELECT ticker, date, k, sum(x * c) ^ 2 + sum(x * s) ^ 2 AS p FROM dft_w JOIN dft_b USING (t) GROUP BY 1, 2, 3),
dft_r AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY p DESC, k DESC) AS r, sum(p) OVER (PARTITION BY ticker, date) AS tot FROM dft_p),
dft AS (SELECT ticker, date, sum(CASE WHEN r <= 3 THEN p END) / max(tot) AS conc,
          -sum(CASE WHEN p > 0 THEN p / tot * ln(p / tot) END) / ln(30) AS h,
          max(CASE WHEN r = 1 THEN k END) / 60.0 AS f1, max(CASE WHEN r = 2 THEN k END) / 60.0 AS f2, max(CASE WHEN r = 3 THEN k END) / 60.0 AS f3,
          sqrt(max(CASE WHEN r = 1 THEN p END)) AS a1, sqrt(max(CASE WHEN r = 2 THEN p END)) AS a2, sqrt(max(CASE WHEN r = 3 THEN p END)) AS a3
        FROM dft_r GROUP BY 1, 2)"""
FOURIER = tr.spectral_fields(3)


@query(
    "fourier_features",
    sp.with_(
        FOURIER_SQL,
        f"""SELECT l.ticker, l.date, {rs(', '.join('fourier_' + f for f in FOURIER))} FROM (
  SELECT l.ticker, l.date, conc AS fourier_energy_concentration, h AS fourier_spectral_entropy, conc / (1 + h) AS fourier_cycle_clarity,
    a1 * conc AS fourier_cycle_strength, h / (1 + conc) AS fourier_noise_diffusion, {", ".join(
        f"f{k} AS fourier_freq_{k}, 1 / f{k} AS fourier_period_{k}, a{k} AS fourier_amp_{k}" for k in (1, 2, 3))}
  FROM light l LEFT JOIN dft ON l.ticker = dft.ticker AND l.date = dft.date) l""",
    ),
)
def fourier_features(spark, sf):
    return shown(tr.fourier(fx.bars(spark, sf)), "ticker", "date", *[f"fourier_{f}" for f in FOURIER])


def _halved(x: list[float]) -> tuple[list[float], list[float]]:
    """Low- and high-pass halves of one periodic signal, from the filter's definition."""
    low = tr.DB4_LOW
    high = [(-1) ** (k + 1) * low[7 - k] for k in range(8)]
    picked = [[x[(2 * i + 4 - k) % len(x)] for k in range(8)] for i in range(len(x) // 2)]
    return tuple([sum(f * v for f, v in zip(taps, p)) for p in picked] for taps in (low, high))


def _wavelet_sql() -> str:
    """Three levels over 64 values as a table of coefficients (part, row, place, weight): responses to unit signals."""
    rows = []
    for place in range(64):
        signal = [float(i == place) for i in range(64)]
        for part in ("1", "2", "3"):
            signal, detail = _halved(signal)
            rows += [f"('{part}', {i}, {place}, {v!r})" for i, v in enumerate(detail) if v]
        rows += [f"('a', {i}, {place}, {v!r})" for i, v in enumerate(signal) if v]
    return f"""
wm(part, i, place, w) AS (VALUES {', '.join(rows)}),
wv AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n, ln(adj_close) AS v FROM bars),
wc AS (SELECT e.ticker, e.date, part, i, sum(w * x.v) AS c FROM wv e JOIN wv x ON x.ticker = e.ticker AND x.n BETWEEN e.n - 63 AND e.n JOIN wm ON wm.place = x.n - e.n + 63 WHERE e.n >= 64 GROUP BY 1, 2, 3, 4),
wd AS (SELECT i, sum(CASE place WHEN 63 THEN w WHEN 0 THEN -w ELSE 0 END) AS d FROM wm WHERE part = 'a' GROUP BY 1),
we AS (SELECT ticker, date, sum(c * c) FILTER (part = '1') AS e1, sum(c * c) FILTER (part = '2') AS e2, sum(c * c) FILTER (part = '3') AS e3, sum(c * c) AS t, exp(sum(c * d) FILTER (part = 'a')) - 1 AS tr FROM wc LEFT JOIN wd ON wc.part = 'a' AND wc.i = wd.i GROUP BY 1, 2),
wavelets AS (SELECT b.ticker, b.date, tr AS wavelet_trend_return, e1 / t AS wavelet_short_noise_intensity, tr / (1 + e1 / t) AS wavelet_clean_trend, abs(tr) / (1 + e1 / t) AS wavelet_trend_quality, e1 / (t + e1) AS wavelet_noise_pressure,
  (e2 + e3) / t AS wavelet_medium_long_energy_share, e1 / t AS wavelet_energy_scale_1, e2 / t AS wavelet_energy_scale_2, e3 / t AS wavelet_energy_scale_3 FROM bars b LEFT JOIN we USING (ticker, date))"""


@query(
    "wavelet_features",
    sp.with_(sp.BARS + "," + _wavelet_sql(), f"SELECT ticker, date, {rs(', '.join('wavelet_' + f for f in tr.wavelet_fields(3)))} FROM wavelets"),
)
def wavelet_features(spark, sf):
    return shown(tr.wavelet(fx.bars(spark, sf)), "ticker", "date", *[f"wavelet_{f}" for f in tr.wavelet_fields(3)])


@query(
    "signal_sources",
    sp.with_(
        sp.BARS,
        f"""SELECT {KEY}{rs('returns, log_price, log_returns')} FROM (SELECT ticker, date, {sp.change('adj_close', 1)} AS returns,
  ln(adj_close) AS log_price, ln(adj_close) - lag(ln(adj_close)) OVER (PARTITION BY ticker ORDER BY date) AS log_returns FROM bars)""",
    ),
)
def signal_sources(spark, sf):
    modes = ("returns", "log_price", "log_returns")
    return shown(fx.bars(spark, sf).select("ticker", "date", *[tr.signal_source(F.col("adj_close"), m).alias(m) for m in modes]))
