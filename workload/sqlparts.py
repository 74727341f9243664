"""SQL definitions of the derived inputs, as common table expressions."""

from __future__ import annotations

from tickerloom import fixed

TRAIN, TEST, EMBARGO = 504, 126, 20


def _priced(source: str, key: str, scale: float) -> str:
    return f"""
SELECT *, 100 * exp(sum(shock) OVER (PARTITION BY {key} ORDER BY date)) AS adj_close FROM (
  SELECT *, {scale} * (level - avg(level) OVER (PARTITION BY {key}))
            / stddev_samp(level) OVER (PARTITION BY {key}) AS shock FROM {source})"""


def _ohlc(source: str) -> str:
    return f"""
SELECT ticker, date, open, greatest(open, adj_close) * (1 + 0.001 * n_rows) AS high,
       least(open, adj_close) * (1 - 0.001 * n_rows) AS low, adj_close AS close, adj_close, volume
FROM (SELECT *, coalesce(lag(adj_close) OVER (PARTITION BY ticker ORDER BY date), adj_close) AS open FROM {source})"""


BARS = f"""
bars_d AS MATERIALIZED (
  SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS ticker, CAST(l_shipdate AS DATE) AS date,
         avg(l_extendedprice / l_quantity) AS level, sum(l_quantity) AS volume, count(*) AS n_rows
  FROM lineitem GROUP BY 1, 2),
bars_p AS ({_priced("bars_d", "ticker", 0.025)}),
bars AS MATERIALIZED ({_ohlc("bars_p")})"""


BENCH = f"""
bench_d AS (
  SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS a, CAST(count(*) AS DOUBLE) AS b
  FROM orders GROUP BY 1),
bench_l AS (SELECT 'SPY' AS symbol, date, a AS level FROM bench_d
            UNION ALL SELECT 'QQQ', date, b FROM bench_d),
bench AS MATERIALIZED (SELECT symbol, date, adj_close AS price FROM ({_priced("bench_l", "symbol", 0.01)}))"""

BASKETS = """
baskets AS (
  SELECT r_name AS layer, n_name AS sector, concat('S', CAST(s_suppkey AS VARCHAR)) AS ticker
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

EARNINGS = """
earnings AS MATERIALIZED (
  SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS ticker,
         max(CAST(o_orderdate AS DATE)) AS earnings_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY l_suppkey, date_trunc('quarter', o_orderdate))"""


def rolled(fn: str, x: str, rows: int, minimum: int | None = None) -> str:
    frame = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {minimum or rows} THEN {fn} {frame} END"


def change(x: str, rows: int) -> str:
    return f"{x} / lag({x}, {rows}) OVER (PARTITION BY ticker ORDER BY date) - 1"


def carried(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"


ALIGNED = BARS + "," + BENCH + f""",
bench_w AS (SELECT date, max(CASE WHEN symbol = 'SPY' THEN price END) AS spy,
                   max(CASE WHEN symbol = 'QQQ' THEN price END) AS qqq FROM bench GROUP BY date),
light_r AS (SELECT b.*, {carried("w.spy")} AS px_spy, {carried("w.qqq")} AS px_qqq,
              {change("adj_close", 1)} AS daily_return,
              {", ".join(f"{change('adj_close', w)} AS return_{w}d" for w in (5, 20, 60, 120))}
            FROM bars b LEFT JOIN bench_w w USING (date)),
light AS MATERIALIZED (SELECT *, {", ".join(
    f"{rolled('stddev_samp(daily_return)', 'daily_return', w)} * sqrt(252) AS volatility_{w}d" for w in (20, 60))}
  FROM light_r)"""


def drops(source: str, windows=(60, 120)) -> str:
    """In-window drawdown by a self-join on row numbers."""
    widest = max(windows)
    cases = ", ".join(
        f"CASE WHEN max(a_rn) >= {w} THEN min(CASE WHEN back < {w} THEN p / peak_{w} END) - 1 END AS max_drawdown_{w}d"
        for w in windows
    )
    peaks = ", ".join(
        f"max(CASE WHEN a.rn - b.rn < {w} THEN b.p END) OVER (PARTITION BY a.ticker, a.rn ORDER BY b.rn) AS peak_{w}"
        for w in windows
    )
    return f"""
drop_n AS MATERIALIZED (SELECT ticker, date, adj_close AS p,
             row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM {source}),
drop_j AS (SELECT a.ticker, a.date, a.rn AS a_rn, a.rn - b.rn AS back, b.p, {peaks}
           FROM drop_n a JOIN drop_n b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn - {widest - 1} AND a.rn),
drops AS MATERIALIZED (SELECT ticker, date, {cases} FROM drop_j GROUP BY ticker, date)"""


TECHNICAL = ALIGNED + "," + drops("bars") + f""",
tech_m AS (SELECT *, adj_close - lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) AS mv FROM light),
tech_a AS (SELECT *,
    {", ".join(f"{rolled('avg(adj_close)', 'adj_close', w)} AS ma_{w}d" for w in (50, 200))},
    {", ".join(f"(volume - {rolled('avg(volume)', 'volume', w)}) / nullif({rolled('stddev_samp(volume)', 'volume', w)}, 0) AS volume_z_{w}d" for w in (20, 60))},
    {rolled('avg(greatest(mv, 0.0))', 'mv', 14)} AS g, {rolled('avg(-least(mv, 0.0))', 'mv', 14)} AS l,
    {", ".join(f"({change('adj_close', w)}) - ({change(f'px_{s}', w)}) AS rs_{s}_{w}d" for s in ('spy', 'qqq') for w in (60, 120))}
  FROM tech_m),
technical AS MATERIALIZED (SELECT tech_a.* EXCLUDE (mv, g, l), adj_close / ma_50d - 1 AS dist_ma_50d,
    adj_close / ma_200d - 1 AS dist_ma_200d,
    CASE WHEN l = 0 AND g > 0 THEN 100.0 WHEN l = 0 AND g = 0 THEN 50.0
         ELSE 100.0 - 100.0 / (1 + g / nullif(l, 0)) END AS rsi_14d,
    drops.max_drawdown_60d, drops.max_drawdown_120d
  FROM tech_a JOIN drops USING (ticker, date))"""

FEATURED = TECHNICAL + f""",
reg_t AS (SELECT *, {rolled('median(volatility_60d)', 'volatility_60d', 252, 60)} AS med FROM technical),
reg_f AS (SELECT *, coalesce(med, median(med) OVER (PARTITION BY ticker), 0.30) AS thr FROM reg_t),
reg_v AS (SELECT *, coalesce(return_60d, 0) AS r60, coalesce(return_120d, 0) AS r120,
    coalesce(dist_ma_50d, 0) AS d50, coalesce(dist_ma_200d, 0) AS d200, coalesce(volatility_60d, 0) AS v60,
    coalesce(volume_z_20d, 0) AS vz, coalesce(max_drawdown_60d, 0) < -0.12 OR coalesce(max_drawdown_120d, 0) < -0.20 AS fell,
    coalesce(rs_spy_60d, 0) >= -0.02 OR coalesce(rs_qqq_60d, 0) >= -0.02 AS rel FROM reg_f),
featured AS MATERIALIZED (SELECT * EXCLUDE (med, thr, r60, r120, d50, d200, v60, vz, fell, rel),
    CASE WHEN fell AND (r60 < 0 OR d200 < 0) THEN '{fixed.DOWNTREND}'
         WHEN r60 > 0 AND r120 > 0 AND d50 > 0 AND d200 > 0 AND rel
           THEN CASE WHEN v60 > thr OR v60 > 0.35 THEN '{fixed.UP_WILD}' ELSE '{fixed.UP_CALM}' END
         WHEN r60 < 0 OR d50 < 0 OR (vz > 1.5 AND r60 < 0.03) THEN '{fixed.WEAKENING}'
         ELSE '{fixed.SIDEWAYS}' END AS regime,
    concat_ws(', ', CASE WHEN fell THEN 'drawdown' END, CASE WHEN vz > 2 THEN 'volume anomaly' END) AS risk_flags
  FROM reg_v)"""


def lead(x: str, h: int) -> str:
    return f"lead({x}, {h}) OVER (PARTITION BY ticker ORDER BY date)"


def labelled(source: str, name: str, h: int = 20, px: str = "px_spy") -> str:
    ahead = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"""
{name}_a AS (SELECT *, {lead("adj_close", h)} / adj_close - 1 AS forward_{h}d_return,
    {lead(px, h)} / {px} - 1 AS benchmark_forward_{h}d_return,
    CASE WHEN count(adj_close) {ahead} = {h} THEN min(adj_close) {ahead} / adj_close - 1 END AS forward_{h}d_drawdown
  FROM {source}),
{name}_b AS (SELECT *, forward_{h}d_return - benchmark_forward_{h}d_return AS forward_{h}d_excess_return,
    CASE WHEN forward_{h}d_drawdown < 0 THEN -forward_{h}d_drawdown WHEN forward_{h}d_drawdown >= 0 THEN 0 END AS loss_{h}
  FROM {name}_a),
{name}_c AS (SELECT * EXCLUDE (loss_{h}),
    forward_{h}d_excess_return - 0.5 * loss_{h} AS forward_{h}d_risk_adjusted_excess_return,
    forward_{h}d_excess_return - 0.5 * CASE WHEN loss_{h} IS NOT NULL THEN greatest(loss_{h} - 0.10, 0) END
      AS forward_{h}d_tail_risk_adjusted_excess_return FROM {name}_b),
{name} AS MATERIALIZED (SELECT *,
    CAST(forward_{h}d_excess_return > 0.02 AS DOUBLE) AS label_outperform_{h}d,
    CAST(forward_{h}d_risk_adjusted_excess_return > 0.02 AS DOUBLE) AS label_risk_adjusted_outperform_{h}d,
    CAST(forward_{h}d_tail_risk_adjusted_excess_return > 0.02 AS DOUBLE) AS label_tail_risk_adjusted_outperform_{h}d,
    CAST(forward_{h}d_drawdown < -0.10 AS DOUBLE) AS label_drawdown_risk_{h}d FROM {name}_c)"""


LABELLED = ALIGNED + "," + labelled("light", "labelled")
PANEL = FEATURED + "," + labelled("featured", "panel")

FOLDS = f"""
days AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)),
fold_k AS (SELECT unnest(range(0, (SELECT greatest(0, (max(i) + 1 - {TRAIN + EMBARGO + TEST}) // {TEST} + 1) FROM days))) AS k),
folds AS MATERIALIZED (SELECT k + 1 AS fold, a.date AS train_start, b.date AS train_end, c.date AS test_start, d.date AS test_end
  FROM fold_k JOIN days a ON a.i = k * {TEST} JOIN days b ON b.i = k * {TEST} + {TRAIN - 1}
  JOIN days c ON c.i = k * {TEST} + {TRAIN + EMBARGO} JOIN days d ON d.i = k * {TEST} + {TRAIN + EMBARGO + TEST - 1})"""


def scored(source: str, extra: str = "") -> str:
    return FOLDS + f""",
score_p AS (SELECT *, 1 / (1 + exp(-20 * return_20d)) AS p_out, 1 / (1 + exp(-10 * (volatility_20d - 0.42))) AS p_risk FROM {source}),
scores AS MATERIALIZED (SELECT f.fold, p.date, p.ticker, label_outperform_20d AS actual_out, p_out AS probability_out,
    label_drawdown_risk_20d AS actual_risk, p_risk AS probability_risk, forward_20d_return AS forward_return,
    forward_20d_excess_return AS forward_excess_return, forward_20d_drawdown AS forward_drawdown,
    forward_20d_risk_adjusted_excess_return AS forward_risk_adjusted,
    forward_20d_tail_risk_adjusted_excess_return AS forward_tail_adjusted,
    return_60d, volatility_20d{extra}, 100 * greatest(0, least(1, p_out)) AS ml_score
  FROM score_p p JOIN folds f ON p.date BETWEEN f.test_start AND f.test_end
  WHERE label_outperform_20d IS NOT NULL AND p_out IS NOT NULL AND label_drawdown_risk_20d IS NOT NULL AND p_risk IS NOT NULL)"""


SCORES = LABELLED + "," + scored("labelled")
REGIME_SCORES = PANEL + "," + scored("panel", ", regime, dist_ma_200d")


def with_(parts: str, body: str) -> str:
    return f"WITH {parts.strip()}\n{body}"


LINES = f"""
lb_d AS MATERIALIZED (
  SELECT concat('T', CAST(l_linenumber AS VARCHAR)) AS ticker, CAST(l_shipdate AS DATE) AS date,
         avg(l_extendedprice / l_quantity) AS level, sum(l_quantity) AS volume, count(*) AS n_rows
  FROM lineitem GROUP BY 1, 2),
lb_p AS ({_priced("lb_d", "ticker", 0.025)}),
line_bars AS MATERIALIZED ({_ohlc("lb_p")}),
mk_d AS (SELECT 'ALL' AS symbol, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS level FROM lineitem GROUP BY 2),
market AS MATERIALIZED (SELECT date, adj_close AS price FROM ({_priced("mk_d", "symbol", 0.01)}))"""

PORTFOLIO = """
pf_v AS (SELECT l_suppkey, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1),
portfolio AS MATERIALIZED (SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS ticker, row_number() OVER (ORDER BY v DESC, l_suppkey) AS pos
  FROM pf_v QUALIFY pos <= 25)"""


def multiplier(regime: str = "regime") -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.REGIME_MULTIPLIER.items())
    return f"CASE {regime} {cases} ELSE {fixed.UNKNOWN_REGIME_MULTIPLIER} END"


def raw_weight(score: str, risk: str, regime: str, maximum=0.12, high=0.6, moderate=0.4, minimum=0.01) -> str:
    p = f"(CASE WHEN coalesce({risk}, 1) = 0 THEN 1.0 ELSE coalesce({risk}, 1) END)"
    s = f"coalesce({score}, 0)"
    band = f"(CASE WHEN {s} >= 80 THEN 1.0 WHEN {s} >= 60 THEN 0.75 WHEN {s} >= 40 THEN 0.5 WHEN {s} >= 20 THEN 0.25 ELSE 0.0 END)"
    m = f"(CASE WHEN {p} >= {high} THEN 0.0 WHEN {p} >= {moderate} THEN {band} * 0.5 ELSE {band} END)"
    t = f"({maximum} * {m} * ({multiplier(regime)}))"
    return f"CASE WHEN {t} > 0 AND {t} < {minimum} THEN 0.0 ELSE {t} END"


def action(now: str, target: str, minimum: float = 0.01) -> str:
    return (
        f"CASE WHEN {target} <= 0 AND {now} > {minimum} THEN 'Exit' WHEN {target} <= 0 THEN 'Watch' "
        f"WHEN {now} <= {minimum} AND {target} > {minimum} THEN 'Add' WHEN {target} > {now} + {minimum} THEN 'Add' "
        f"WHEN {target} < {now} - {minimum} THEN 'Trim' ELSE 'Hold' END"
    )


_LAG20 = {c: f"lag({c}, 20) OVER (PARTITION BY ticker ORDER BY date)" for c in ("ml_score", "probability_risk", "regime")}

CURRENT = FEATURED + f""",
cur_p AS (SELECT *, 1 / (1 + exp(-20 * return_20d)) AS probability_out, 1 / (1 + exp(-10 * (volatility_20d - 0.42))) AS probability_risk,
  100 * greatest(0, least(1, 1 / (1 + exp(-20 * return_20d)))) AS ml_score FROM featured),
cur_l AS (SELECT *, {_LAG20['ml_score']} AS s0, {_LAG20['probability_risk']} AS r0, {_LAG20['regime']} AS g0,
  row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS newest FROM cur_p),
cur AS MATERIALIZED (SELECT * EXCLUDE (s0, r0, g0, newest), {raw_weight('s0', 'r0', 'g0')} AS current_weight,
  {action('0.0', '(' + raw_weight('s0', 'r0', 'g0') + ')')} AS previous_action FROM cur_l WHERE newest = 1),
cur_r AS (SELECT *, {raw_weight('ml_score', 'probability_risk', 'regime')} AS raw FROM cur),
cur_g AS (SELECT *, sum(raw) OVER () AS gross FROM cur_r),
cur_w AS (SELECT *, CASE WHEN gross > 0.9 THEN 0.9 / gross ELSE 1.0 END AS scale FROM cur_g),
cur_a AS (SELECT *, raw * scale AS target_weight FROM cur_w),
alloc AS MATERIALIZED (SELECT *, {action('current_weight', 'target_weight')} AS suggested_action,
  CASE WHEN rs_spy_60d IS NOT NULL THEN rank() OVER (ORDER BY rs_spy_60d DESC NULLS LAST) END AS rs_rank_min,
  CASE WHEN rs_spy_60d IS NOT NULL THEN rank() OVER (ORDER BY rs_spy_60d DESC NULLS LAST) + (count(*) OVER (PARTITION BY rs_spy_60d) - 1) / 2.0 END AS rs_rank_avg,
  CASE WHEN target_weight / 0.12 >= 0.875 THEN '100%' WHEN target_weight / 0.12 >= 0.625 THEN '75%' WHEN target_weight / 0.12 >= 0.375 THEN '50%'
       WHEN target_weight / 0.12 >= 0.125 THEN '25%' ELSE '0%' END AS bucket,
  CASE WHEN ml_score IS NULL OR probability_risk IS NULL THEN 'Low'
       WHEN greatest(abs(ml_score - 50) / 50, abs(probability_risk - 0.5) * 2) >= 0.5 THEN 'High'
       WHEN greatest(abs(ml_score - 50) / 50, abs(probability_risk - 0.5) * 2) >= 0.2 THEN 'Medium' ELSE 'Low' END AS confidence
  FROM cur_a)"""
