"""Decision views, market stress, rotation and crowding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import cockpit as cp
from tickerloom.operators import crowding as cr
from tickerloom.operators import decision as dc
from tickerloom.operators import features as ft
from tickerloom.operators import rotation as rt
from tickerloom.plans.storage import settle
from workload import fixtures as fx
from workload import sqlparts as sp
from workload.registry import query, r, rs, shown


def _current(spark, sf):
    return settle(fx.current(spark, sf))


def _decision(spark, sf):
    return dc.decision_table(_current(spark, sf))


_PHRASES = """
CASE suggested_action WHEN 'Add' THEN 'Add toward ' || bucket || ' of max position' WHEN 'Hold' THEN 'Hold near ' || bucket || ' of max position'
  WHEN 'Trim' THEN 'Trim toward ' || bucket || ' of max position' ELSE suggested_action || '; target ' || bucket || ' exposure' END || '; ' ||
CASE WHEN regime LIKE 'Downtrend%' THEN 'weak downtrend regime' WHEN regime LIKE 'Distribution%' THEN 'distribution regime'
  WHEN regime LIKE 'Sideways%' THEN 'sideways low-conviction regime' WHEN regime LIKE '%high%' THEN 'uptrend with higher volatility' ELSE 'bullish low-volatility trend' END || '; ' ||
CASE WHEN ml_score IS NULL THEN 'ML score unavailable' ELSE CASE WHEN sc >= 80 THEN 'very high' WHEN sc >= 60 THEN 'constructive' WHEN sc >= 40 THEN 'mixed'
  WHEN sc >= 20 THEN 'weak' ELSE 'very weak' END || ' ML score ' || CAST(CAST(sc AS BIGINT) AS VARCHAR) END || '; ' ||
CASE WHEN probability_risk IS NULL THEN 'drawdown risk unavailable' ELSE CASE WHEN probability_risk >= 0.6 THEN 'high' WHEN probability_risk >= 0.4 THEN 'elevated'
  WHEN probability_risk >= 0.25 THEN 'moderate' ELSE 'low' END || ' drawdown risk ' || CAST(CAST(round(probability_risk * 100) AS BIGINT) AS VARCHAR) || '%' END ||
CASE WHEN rs_rank_min IS NULL THEN '' ELSE '; relative strength rank #' || CAST(rs_rank_min AS VARCHAR) END || '.'"""
DECISION_SQL = sp.CURRENT + f""",
decision AS MATERIALIZED (SELECT ticker, adj_close AS price, regime AS rule_based_regime, sc AS ml_score, probability_risk AS drawdown_risk_probability,
  CAST(rs_rank_min AS DOUBLE) AS relative_strength_rank, suggested_action, bucket AS target_exposure_bucket, confidence, {_PHRASES} AS one_line_reason, previous_action
  FROM (SELECT *, round(ml_score) AS sc FROM alloc))"""
_DEC = f"ticker, {rs('price')}, rule_based_regime, {rs('ml_score, drawdown_risk_probability, relative_strength_rank')}, suggested_action, target_exposure_bucket, confidence, one_line_reason"


@query("decision_table", sp.with_(DECISION_SQL, f"SELECT {_DEC} FROM decision"))
def decision_table(spark, sf):
    return shown(dc.in_action_order(_decision(spark, sf)))


@query(
    "action_counts",
    sp.with_(
        DECISION_SQL,
        "SELECT a.action, CAST(count(d.ticker) AS BIGINT) AS n FROM (SELECT unnest(['Add','Hold','Trim','Exit','Watch']) AS action) a LEFT JOIN decision d ON d.suggested_action = a.action GROUP BY 1",
    ),
)
def action_counts(spark, sf):
    return dc.action_counts(_decision(spark, sf))


@query(
    "shortlist",
    sp.with_(
        DECISION_SQL,
        """SELECT * FROM (SELECT 'All' AS view, ticker FROM decision
UNION ALL SELECT 'Strong setups', ticker FROM decision WHERE ml_score >= 70 AND coalesce(drawdown_risk_probability < 0.6, true) AND suggested_action NOT IN ('Trim', 'Exit', 'Watch', 'Hold')
UNION ALL SELECT 'Watchlist / wait for pullback', ticker FROM decision WHERE (coalesce(ml_score >= 70, false) OR coalesce(relative_strength_rank <= 3, false))
  AND (coalesce(drawdown_risk_probability >= 0.4, false) OR suggested_action IN ('Watch', 'Hold'))
UNION ALL SELECT 'High pullback risk', ticker FROM decision WHERE drawdown_risk_probability >= 0.6
UNION ALL SELECT 'Weak or avoid', ticker FROM decision WHERE suggested_action IN ('Trim', 'Exit') OR coalesce(ml_score <= 40, false))""",
    ),
)
def shortlist(spark, sf):
    table = settle(_decision(spark, sf))
    parts = [dc.shortlist(table, v).select(F.lit(v).alias("view"), "ticker") for v in dc.SHORTLIST_VIEWS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "decision_report",
    sp.with_(
        sp.CURRENT,
        f"""SELECT ticker, {r('adj_close', 'current_price')}, regime AS rule_based_regime, {rs('ml_score')}, {r('probability_risk', 'drawdown_risk_probability')},
  {r('rs_rank_avg', 'relative_strength_rank')}, {r('target_weight', 'current_target_weight')}, suggested_action,
  concat_ws(', ', CASE WHEN volatility_60d > 0.35 THEN 'high volatility' END, CASE WHEN rs_spy_60d < 0 THEN 'weakening relative strength' END,
    CASE WHEN probability_risk > 0.6 THEN 'high drawdown probability' END, CASE WHEN dist_ma_50d < 0 THEN 'below 50dma' END,
    CASE WHEN dist_ma_200d < 0 THEN 'below 200dma' END, CASE WHEN volume_z_20d > 2 THEN 'abnormal volume' END,
    CASE WHEN greatest(abs(probability_out - 0.5), abs(probability_risk - 0.5)) <= 0.1 THEN 'model confidence low' END) AS risk_flags FROM alloc""",
    ),
)
def decision_report(spark, sf):
    return shown(dc.report_table(_current(spark, sf)).drop("explanation"))


@query(
    "change_log",
    sp.with_(
        DECISION_SQL,
        """SELECT ticker, previous_action AS previous, suggested_action AS current, CASE WHEN n > o THEN 'upgrade' ELSE 'downgrade' END AS direction FROM (
  SELECT *, CASE suggested_action WHEN 'Trim' THEN 1 WHEN 'Hold' THEN 2 WHEN 'Add' THEN 3 ELSE 0 END AS n,
    CASE previous_action WHEN 'Trim' THEN 1 WHEN 'Hold' THEN 2 WHEN 'Add' THEN 3 ELSE 0 END AS o FROM decision) WHERE previous_action <> suggested_action""",
    ),
)
def change_log(spark, sf):
    current = _current(spark, sf)
    return dc.change_log(dc.decision_table(current), current.select("ticker", "previous_action"))


@query(
    "risk_state",
    sp.with_(
        DECISION_SQL,
        """SELECT names, high_risk_count, low_confidence_count, "add", hold, trim, exit, watch,
  CASE WHEN high_risk_count >= greatest(2, names // 3) THEN 'elevated' WHEN "add" > trim + exit THEN 'constructive' ELSE 'moderate' END AS risk_state,
  CASE WHEN names = 0 THEN 'no decision rows' WHEN high_risk_count > 0 THEN 'elevated drawdown-risk names'
       WHEN low_confidence_count >= greatest(2, names // 3) THEN 'many low-confidence rows' ELSE 'none' END AS warning FROM (
  SELECT count(*) AS names, count(*) FILTER (drawdown_risk_probability >= 0.6) AS high_risk_count, count(*) FILTER (confidence = 'Low') AS low_confidence_count,
    count(*) FILTER (suggested_action = 'Add') AS "add", count(*) FILTER (suggested_action = 'Hold') AS hold, count(*) FILTER (suggested_action = 'Trim') AS trim,
    count(*) FILTER (suggested_action = 'Exit') AS exit, count(*) FILTER (suggested_action = 'Watch') AS watch FROM decision)""",
    ),
)
def risk_state(spark, sf):
    return dc.risk_state(_decision(spark, sf), "")


@query(
    "evidence_bullets",
    sp.with_(
        sp.CURRENT,
        """SELECT ticker, suggested_action, CASE WHEN b = '' THEN 'no bullish evidence' ELSE b END AS bullish, CASE WHEN s = '' THEN 'no major risk flag' ELSE s END AS bearish FROM (
  SELECT ticker, suggested_action, array_to_string(list_filter([CASE WHEN dist_ma_50d > 0 THEN 'above 50-day average' END, CASE WHEN dist_ma_200d > 0 THEN 'above 200-day average' END,
      CASE WHEN coalesce(rs_qqq_60d, rs_spy_60d) > 0 THEN 'positive relative strength' END, CASE WHEN probability_out >= 0.6 THEN 'outperformance probability high' END], lambda x: x IS NOT NULL)[1:3], '; ') AS b,
    array_to_string(list_filter([CASE WHEN probability_risk >= 0.6 THEN 'drawdown-risk probability elevated' END, CASE WHEN volatility_60d > 0.35 THEN 'volatility elevated' END,
      CASE WHEN dist_ma_50d < 0 THEN 'below 50-day average' END, CASE WHEN dist_ma_200d < 0 THEN 'below 200-day average' END,
      CASE WHEN volume_z_20d > 2 THEN 'volume unusually high' END], lambda x: x IS NOT NULL)[1:3], '; ') AS s FROM alloc)""",
    ),
)
def evidence_bullets(spark, sf):
    from tickerloom.operators.allocation import allocate

    out = dc.evidence(allocate(_current(spark, sf)))
    return out.select(
        "ticker", "suggested_action", F.array_join("bullish_evidence", "; ").alias("bullish"), F.array_join("bearish_evidence", "; ").alias("bearish")
    )


OVERVIEW = "daily_return, return_20d, return_60d, return_120d, volatility_60d, max_drawdown_60d, rs_spy_60d, rs_qqq_60d, volume_z_20d"


@query("market_overview", sp.with_(sp.CURRENT, f"SELECT ticker, date, {r('adj_close', 'close')}, regime, risk_flags, {rs(OVERVIEW)} FROM cur"))
def market_overview(spark, sf):
    return shown(dc.overview(fx.featured(spark, sf)))


@query(
    "portfolio_selection",
    sp.with_(sp.CURRENT + "," + sp.PORTFOLIO, f"SELECT p.pos, ticker, date, {r('adj_close', 'price')} FROM cur JOIN portfolio p USING (ticker)"),
)
def portfolio_selection(spark, sf):
    latest = dc.latest_rows(fx.bars(spark, sf)).withColumn("price", F.col("adj_close"))
    return shown(dc.only_listed(latest, fx.portfolio(spark, sf)), "pos", "ticker", "date", "price")


def _snap(source: str, drops: str) -> str:
    """Metric snapshot of every ticker of ``source`` (ticker, date, adj_close)."""
    rl = sp.rolled
    cols = {
        "return_20d": "r20", "return_60d": "r60", "return_120d": "r120", "vs_50dma": "d50", "vs_200dma": "d200", "drawdown_60d": "max_drawdown_60d",
        "drawdown_120d": "max_drawdown_120d", "from_126d_high": "hi", "vol_20d": "v20", "vol_60d": "v60",
    }
    last = ", ".join(f"arg_max({c}, date) FILTER ({c} IS NOT NULL) AS {n}" for n, c in cols.items())
    return f"""
sn_r AS (SELECT *, {sp.change('adj_close', 1)} AS ret FROM {source}),
sn_a AS (SELECT ticker, date, adj_close, {sp.change('adj_close', 20)} AS r20, {sp.change('adj_close', 60)} AS r60, {sp.change('adj_close', 120)} AS r120,
  adj_close / ({rl('avg(adj_close)', 'adj_close', 50)}) - 1 AS d50, adj_close / ({rl('avg(adj_close)', 'adj_close', 200)}) - 1 AS d200,
  adj_close / ({rl('max(adj_close)', 'adj_close', 126, 20)}) - 1 AS hi, ({rl('stddev_samp(ret)', 'ret', 20)}) * sqrt(252) AS v20,
  ({rl('stddev_samp(ret)', 'ret', 60)}) * sqrt(252) AS v60 FROM sn_r),
snap AS MATERIALIZED (SELECT *, CASE WHEN vol_60d > 0 THEN vol_20d / vol_60d - 1 END AS vol_expansion FROM (
  SELECT ticker, max(date) AS date, arg_max(adj_close, date) AS price, {last} FROM sn_a JOIN {drops} USING (ticker, date) GROUP BY ticker))"""


def _rel(bars: str, bench: str, name: str) -> str:
    return f"""
{name} AS (SELECT ticker, max(CASE WHEN k = 1 THEN p END) / max(CASE WHEN k = 61 THEN p END) - max(CASE WHEN k = 1 THEN q END) / max(CASE WHEN k = 61 THEN q END) AS rs
  FROM (SELECT a.ticker, a.adj_close AS p, b.price AS q, row_number() OVER (PARTITION BY a.ticker ORDER BY a.date DESC) AS k FROM {bars} a JOIN {bench} b ON a.date = b.date)
  WHERE k IN (1, 61) GROUP BY ticker)"""


LINE_SNAP = sp.LINES + "," + sp.drops("line_bars") + "," + _snap("line_bars", "drops")
MS = "rs_60d, vs_50dma, vs_200dma, from_126d_high, return_20d, return_60d, vol_expansion, bond_vs_200dma"


@query(
    "market_stress",
    sp.with_(
        LINE_SNAP + ", base AS (SELECT date, adj_close AS price FROM line_bars WHERE ticker = 'T2'), lead_b AS (SELECT * FROM line_bars WHERE ticker = 'T1')," + _rel("lead_b", "base", "rl") + """,
f AS (SELECT s.*, rl.rs AS rs_60d, (SELECT vs_200dma FROM snap WHERE ticker = 'T3') AS bond_vs_200dma FROM snap s LEFT JOIN rl USING (ticker) WHERE s.ticker = 'T1'),
g AS (SELECT *, coalesce(vs_200dma, 0) < 0 AS a, coalesce(vs_50dma, 0) < 0 AND coalesce(return_20d, 0) < 0 AS b, coalesce(from_126d_high, 0) <= -0.1 AS c, coalesce(rs_60d <= -0.03, false) AS d FROM f)""",
        f"""SELECT CASE WHEN rs_60d IS NULL THEN 'Elevated' WHEN a OR a::INT + b::INT + c::INT + d::INT >= 3 THEN 'Stressed' WHEN a OR b OR c OR d THEN 'Elevated' ELSE 'Normal' END AS state, {rs(MS)},
  concat_ws('; ', CASE WHEN a THEN 'below 200DMA' END, CASE WHEN b THEN 'below 50DMA with negative 20d return' END, CASE WHEN c THEN 'more than 10% below 126d high' END,
    CASE WHEN d THEN 'lagging over 60d' END) AS deterioration, coalesce(vol_expansion, 0) >= 0.25 AS volatility_warning FROM g""",
    ),
)
def market_stress(spark, sf):
    return shown(cp.market_stress(ft.technical(fx.line_bars(spark, sf)), "T1", "T2", "T3"))


TS = "rs_60d, vs_50dma, vs_200dma, from_126d_high, return_20d, return_60d"


@query(
    "theme_stress",
    sp.with_(
        LINE_SNAP + ", base AS (SELECT date, adj_close AS price FROM line_bars WHERE ticker = 'T1'), lead_b AS (SELECT * FROM line_bars WHERE ticker IN ('T4', 'T5'))," + _rel("lead_b", "base", "rl") + """,
f AS (SELECT s.*, rl.rs AS rs_60d FROM snap s LEFT JOIN rl USING (ticker) WHERE s.ticker IN ('T4', 'T5')),
g AS (SELECT *, rs_60d IS NULL AS m, rs_60d IS NULL OR coalesce(vs_50dma, 0) < 0 OR coalesce(rs_60d <= -0.03, false) OR coalesce(from_126d_high, 0) <= -0.1 AS w,
  coalesce(vs_200dma, 0) < 0 OR coalesce(rs_60d <= -0.08, false) OR coalesce(from_126d_high, 0) <= -0.18 AS s,
  coalesce(return_20d < 0, false) OR coalesce(from_126d_high <= -0.05, false) AS cool FROM f),
h AS (SELECT sum(m::INT) AS ms, sum(w::INT) AS ws, sum(s::INT) AS ss FROM g)""",
        f"""SELECT CASE WHEN ss = 2 THEN 'Stressed' WHEN ms > 0 THEN 'Mixed' WHEN ws = 0 THEN 'Healthy' WHEN ws = 2 THEN 'Weakening' ELSE 'Mixed' END AS state, ticker, {rs(TS)},
  CASE WHEN m THEN 'incomplete' WHEN s THEN 'stressed' WHEN w THEN 'weakening' WHEN cool THEN 'cooling' ELSE 'healthy' END AS read FROM g, h""",
    ),
)
def theme_stress(spark, sf):
    return shown(cp.theme_stress(ft.technical(fx.line_bars(spark, sf)), ["T4", "T5"], "T1"))


TH = "price, return_20d, return_60d, return_120d, rs_base_60d, rs_theme_60d, vs_50dma, vs_200dma, from_126d_high, drawdown_60d, vol_expansion"
_C = "coalesce({0}, 0)"


@query(
    "trend_health",
    sp.with_(
        sp.BARS + "," + sp.BENCH + "," + sp.drops("bars") + "," + _snap("bars", "drops")
        + ", qqq AS (SELECT date, price FROM bench WHERE symbol = 'QQQ'), spy AS (SELECT date, price FROM bench WHERE symbol = 'SPY'),"
        + _rel("bars", "qqq", "r1") + "," + _rel("bars", "spy", "r2"),
        f"""SELECT ticker, date, {rs(TH)}, CASE
  WHEN b200 AND (coalesce(drawdown_120d <= -0.2, false) OR coalesce(return_60d <= -0.1, false) OR coalesce(rs_base_60d <= -0.08, false)) THEN 'Risk reduction candidate'
  WHEN b200 OR (b50 AND coalesce(return_60d, 0) < 0 AND coalesce(rs_base_60d, 0) < 0) THEN 'Trend damage'
  WHEN coalesce(vs_50dma, 0) >= 0.12 AND coalesce(return_20d, 0) >= 0.08 AND coalesce(from_126d_high, 0) >= -0.05 THEN 'Extended, do not chase'
  WHEN NOT b200 AND (b50 OR coalesce(drawdown_60d BETWEEN -0.12 AND -0.05, false)) THEN 'Normal pullback'
  WHEN coalesce(vs_50dma, 0) >= 0 AND coalesce(vs_200dma, 0) >= 0 AND coalesce(return_60d, 0) >= 0 AND coalesce(rs_base_60d >= -0.02, true) THEN 'Healthy trend'
  ELSE 'Watch only' END AS state FROM (SELECT s.*, r1.rs AS rs_base_60d, r2.rs AS rs_theme_60d, coalesce(vs_50dma < 0, false) AS b50, coalesce(vs_200dma < 0, false) AS b200
  FROM snap s LEFT JOIN r1 USING (ticker) LEFT JOIN r2 USING (ticker))""",
    ),
)
def trend_health(spark, sf):
    bench = fx.benchmarks(spark, sf)
    series = [bench.filter(F.col("symbol") == s).select("date", "price") for s in ("QQQ", "SPY")]
    return shown(cp.trend_health(ft.technical(fx.bars(spark, sf)), *series), "ticker", "date", "state", *TH.split(", "))


@query(
    "broad_pullback",
    sp.with_(
        sp.LINES + """,
sig AS (SELECT date, price, row_number() OVER (ORDER BY date DESC) AS k FROM market),
sec AS (SELECT ticker, max(CASE WHEN k = 1 THEN adj_close END) / max(CASE WHEN k = 6 THEN adj_close END) - 1 AS ret FROM line_bars JOIN sig USING (date) WHERE k <= 6 GROUP BY 1 HAVING count(*) = 6),
n AS (SELECT count(*) AS available_sector_count, count(*) FILTER (ret < 0) AS negative_sector_count FROM sec),
m AS (SELECT max(date) AS as_of, CASE WHEN count(*) = 200 THEN arg_max(price, date) >= avg(price) END AS above_200dma FROM sig WHERE k <= 200)""",
        """SELECT CASE WHEN available_sector_count < 7 OR above_200dma IS NULL THEN 'Unavailable' WHEN negative_sector_count = 7 AND above_200dma THEN 'Confirmed' ELSE 'Not confirmed' END AS status,
  as_of, negative_sector_count, available_sector_count, above_200dma FROM n, m""",
    ),
)
def broad_pullback(spark, sf):
    return cp.broad_pullback(fx.line_bars(spark, sf), fx.market(spark, sf), 7)


_LAYER_VALUES = ", ".join(f"('{t}', '{a}')" for t, a in fx.LAYERS.items())
ROTATION_SQL = sp.LINES + f""",
lay AS (SELECT t.* FROM (VALUES {_LAYER_VALUES}) t(ticker, layer)),
cal AS MATERIALIZED (SELECT date, price, row_number() OVER (ORDER BY date DESC) AS k, price / lag(price) OVER (ORDER BY date) - 1 AS b FROM market QUALIFY k <= 61),
win AS (SELECT unnest([1, 5, 20, 60])::BIGINT AS w),
bn AS (SELECT w, product(CASE WHEN k <= w THEN 1 + b END) - 1 AS benchmark_return, max(date) AS as_of FROM win JOIN cal ON k <= w + 1 GROUP BY w HAVING count(*) = w + 1),
px AS (SELECT l.layer, ticker, date, adj_close, k, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM line_bars JOIN cal USING (date) JOIN lay l USING (ticker)),
pw AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY ticker, w) AS n FROM px JOIN win ON k <= w + 1 QUALIFY n = w + 1),
mem AS (SELECT layer, w, string_agg(ticker, ',' ORDER BY ticker) AS available_constituents, count(*) AS av, avg((ret > 0)::INT) AS breadth FROM (
  SELECT layer, w, ticker, max(CASE WHEN k = 1 THEN adj_close END) / max(CASE WHEN k = w + 1 THEN adj_close END) - 1 AS ret FROM pw GROUP BY 1, 2, 3) GROUP BY 1, 2),
dly AS (SELECT layer, w, date, avg(ret) AS rr FROM pw WHERE k <= w GROUP BY 1, 2, 3),
wl AS (SELECT *, product(1 + rr) OVER (PARTITION BY layer, w ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM dly),
wd AS (SELECT *, wealth / greatest(1.0, max(wealth) OVER (PARTITION BY layer, w ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM wl),
bas AS (SELECT layer, w, product(1 + rr) - 1 AS basket_return, CASE WHEN count(*) > 1 THEN stddev_pop(rr) * sqrt(252) END AS annualized_volatility, least(0.0, min(dd)) AS max_drawdown FROM wd GROUP BY 1, 2),
det AS MATERIALIZED (SELECT as_of, layer, tickers, w AS "window", coalesce(available_constituents, '') AS available_constituents, cc AS constituent_count, coalesce(av, 0) / cc AS coverage, basket_return,
  CASE WHEN basket_return IS NOT NULL THEN benchmark_return END AS benchmark_return, basket_return - benchmark_return AS relative_return, breadth, annualized_volatility, max_drawdown
  FROM (SELECT layer, string_agg(ticker, ',' ORDER BY ticker) AS tickers, count(*) AS cc FROM lay GROUP BY 1) CROSS JOIN bn LEFT JOIN mem USING (layer, w) LEFT JOIN bas USING (layer, w))"""


@query(
    "basket_rotation",
    sp.with_(
        ROTATION_SQL,
        f"""SELECT as_of, layer, tickers, "window", available_constituents, constituent_count, {rs('coverage, basket_return, benchmark_return, relative_return, breadth, annualized_volatility, max_drawdown')} FROM det""",
    ),
)
def basket_rotation(spark, sf):
    return shown(rt.detail(fx.line_bars(spark, sf), fx.layers(spark, sf), fx.market(spark, sf)))


@query(
    "rotation_summary",
    sp.with_(
        ROTATION_SQL + """,
m AS (SELECT CASE WHEN count(*) = 200 THEN arg_max(price, date) >= avg(price) END AS above FROM (SELECT * FROM market QUALIFY row_number() OVER (ORDER BY date DESC) <= 200)),
s AS (SELECT max(as_of) AS as_of, count(*) AS layers, count(relative_return) AS av, count(*) FILTER (basket_return > 0) AS up, count(*) FILTER (basket_return < 0) AS dn,
  arg_max(layer, (relative_return, layer)) FILTER (relative_return IS NOT NULL) AS ld, arg_min(layer, (relative_return, layer)) FILTER (relative_return IS NOT NULL) AS lg,
  max(relative_return) - min(relative_return) AS st FROM det WHERE "window" = 5)""",
        f"""SELECT as_of, '5d' AS signal_window, CASE WHEN av <> layers OR above IS NULL THEN 'unavailable' WHEN above THEN 'above 200d average' ELSE 'below 200d average' END AS benchmark_trend,
  CASE WHEN av <> layers THEN 'Unavailable' WHEN dn = layers AND above THEN 'Broad pullback' WHEN dn = layers AND NOT above THEN 'Elevated tail risk' WHEN dn = layers THEN 'Broad selloff'
    WHEN up > 0 AND dn > 0 THEN 'Rotation' WHEN up = layers THEN 'Broad advance' ELSE 'Mixed' END AS market_state,
  CASE WHEN av <> layers THEN 'insufficient_data' WHEN dn = layers AND above THEN 'broad pullback' WHEN dn = layers AND NOT above THEN 'bear-market selloff' WHEN dn = layers THEN 'regime unconfirmed'
    WHEN up = 1 AND dn > 0 THEN 'crowded rotation' WHEN up > 0 AND dn > 0 THEN 'healthy rotation' WHEN up = layers THEN 'healthy rotation' ELSE 'crowded rotation' END AS classification,
  CASE WHEN av = layers THEN ld END AS leading_layer, CASE WHEN av = layers THEN lg END AS lagging_layer, {r('CASE WHEN av = layers THEN st END', 'rotation_strength')},
  CASE WHEN av <> layers THEN 'unavailable' WHEN st < 0.02 THEN 'weak' WHEN st < 0.05 THEN 'moderate' ELSE 'strong' END AS strength_label,
  up AS positive_layer_count, dn AS negative_layer_count, av AS available_layer_count, av = layers AND dn = layers AS all_layers_weaker FROM s, m""",
    ),
)
def rotation_summary(spark, sf):
    bench = fx.market(spark, sf)
    return shown(rt.summary(rt.detail(fx.line_bars(spark, sf), fx.layers(spark, sf), bench), bench))


def pair_sql(high: float, moderate: float) -> str:
    return sp.BARS + "," + sp.PORTFOLIO + f""",
rt AS MATERIALIZED (SELECT ticker, pos, date, {sp.change('adj_close', 1)} AS ret FROM bars JOIN portfolio USING (ticker)),
pr AS (SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, a.ret AS x, b.ret AS y, row_number() OVER (PARTITION BY a.ticker, b.ticker ORDER BY a.date DESC) AS k
  FROM rt a JOIN rt b ON a.date = b.date AND a.pos < b.pos WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL),
pc AS (SELECT ticker_a, ticker_b, count(*) AS n, corr(x, y) AS c FROM pr WHERE k <= 60 GROUP BY 1, 2),
pairs AS MATERIALIZED (SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, coalesce(n, 0) AS sample_count, CAST(60 AS BIGINT) AS rolling_window_days, CASE WHEN n >= 20 THEN c END AS correlation,
  CASE WHEN coalesce(n, 0) < 20 THEN 'insufficient_sample' WHEN c >= {high} THEN 'high_overlap' WHEN c >= {moderate} THEN 'moderate_overlap' ELSE 'diversifying' END AS classification
  FROM portfolio a JOIN portfolio b ON a.pos < b.pos LEFT JOIN pc ON pc.ticker_a = a.ticker AND pc.ticker_b = b.ticker)"""


@query("pair_correlation", sp.with_(pair_sql(0.8, 0.5), f"SELECT ticker_a, ticker_b, sample_count, rolling_window_days, {rs('correlation')}, classification FROM pairs"))
def pair_correlation(spark, sf):
    return shown(cr.pair_correlation(fx.bars(spark, sf), fx.portfolio(spark, sf)))


# Random series hardly correlate, so the cluster queries call 0.15 high.
CLUSTER_SQL = f"""WITH RECURSIVE {pair_sql(0.15, 0.05).strip()},
ed AS MATERIALIZED (SELECT ticker_a AS u, ticker_b AS v FROM pairs WHERE classification = 'high_overlap' UNION SELECT ticker_b, ticker_a FROM pairs WHERE classification = 'high_overlap'),
reach AS (SELECT DISTINCT u, u AS v FROM ed UNION SELECT reach.u, ed.v FROM reach JOIN ed ON reach.v = ed.u),
clus AS MATERIALIZED (SELECT u AS ticker, min(v) AS cluster FROM reach GROUP BY u)
"""


@query("clusters", CLUSTER_SQL + "SELECT ticker, cluster FROM clus")
def clusters(spark, sf):
    pairs = cr.pair_correlation(fx.bars(spark, sf), fx.portfolio(spark, sf), high=0.15, moderate=0.05)
    return cr.components(pairs.filter("classification = 'high_overlap'"))


@query(
    "crowding",
    CLUSTER_SQL
    + f"""SELECT 'portfolio_correlation_crowding' AS diagnostic, nt AS ticker_count, sc AS sample_count, hi AS high_overlap_pair_count, {r('av', 'average_pairwise_correlation')}, {r('mx', 'max_pairwise_correlation')},
  lc AS largest_cluster_size, CASE WHEN av IS NULL THEN 'insufficient_sample' WHEN av >= 0.65 OR lc >= ceil(nt * 0.5) OR hi >= greatest(2, ceil(nt / 3)) THEN 'high_crowding'
  WHEN av >= 0.45 OR hi > 0 THEN 'moderate_crowding' ELSE 'low_crowding' END AS classification FROM (
  SELECT (SELECT count(*) FROM portfolio) AS nt, coalesce(min(sample_count) FILTER (correlation IS NOT NULL), 0) AS sc, count(*) FILTER (classification = 'high_overlap') AS hi, avg(correlation) AS av, max(correlation) AS mx,
    (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM clus GROUP BY cluster)) AS lc FROM pairs)""",
)
def crowding(spark, sf):
    portfolio = fx.portfolio(spark, sf)
    return shown(cr.summary(cr.pair_correlation(fx.bars(spark, sf), portfolio, high=0.15, moderate=0.05), portfolio))


def _proxies(spark, sf):
    s = fx.table(spark, sf, "supplier").join(fx.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.join(fx.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
        F.col("r_name").alias("proxy_group"),
        F.when(F.col("s_acctbal") < 0, "proxy_only").otherwise("mapped").alias("classification"),
    )


PROXY_SQL = sp.PORTFOLIO + """,
prox AS (SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS ticker, r_name AS proxy_group, CASE WHEN s_acctbal < 0 THEN 'proxy_only' ELSE 'mapped' END AS classification
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
expo AS MATERIALIZED (SELECT ticker, pos, proxy_group, CASE classification WHEN 'mapped' THEN 'static_ticker_proxy' ELSE 'static_etf_proxy' END AS proxy_source, classification FROM portfolio JOIN prox USING (ticker))"""


@query("factor_exposure", sp.with_(PROXY_SQL, "SELECT * FROM expo"))
def factor_exposure(spark, sf):
    return shown(cr.factor_exposure(fx.portfolio(spark, sf), _proxies(spark, sf)))


@query(
    "factor_crowding",
    sp.with_(
        PROXY_SQL,
        """SELECT proxy_group, count(*) AS ticker_count, string_agg(ticker, ',' ORDER BY pos) AS tickers, CASE WHEN count(*) / (SELECT count(*) FROM expo) >= 0.4
  OR (bool_or(classification = 'mapped') AND bool_or(classification = 'proxy_only')) THEN 'crowded' WHEN count(*) / (SELECT count(*) FROM expo) >= 0.25 THEN 'watch' ELSE 'low' END AS classification FROM expo GROUP BY 1""",
    ),
)
def factor_crowding(spark, sf):
    return cr.factor_crowding(cr.factor_exposure(fx.portfolio(spark, sf), _proxies(spark, sf)))
