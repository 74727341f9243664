"""Backtests, allocation and portfolio accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom import fixed
from tickerloom.operators import allocation as al
from tickerloom.operators import backtest as bt
from tickerloom.plans.storage import settle
from workload import fixtures as fx
from workload import sqlparts as sp
from workload.registry import query, r, rs, shown

OVER = "OVER (PARTITION BY ticker ORDER BY date)"
SO_FAR = "OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"


def perf_sql(ret: str, dd: str) -> str:
    return ", ".join(
        [
            r(f"CASE WHEN product(1 + {ret}) > 0 THEN pow(product(1 + {ret}), 252.0 / count({ret})) - 1 END", "cagr"),
            r(f"stddev_samp({ret}) * sqrt(252)", "annualized_volatility"),
            r(f"avg({ret}) / nullif(stddev_samp({ret}), 0) * sqrt(252)", "sharpe"),
            r(f"avg({ret}) / nullif(stddev_samp({ret}) FILTER ({ret} < 0), 0) * sqrt(252)", "sortino"),
            r(f"min({dd})", "max_drawdown"),
            r(f"avg(CASE WHEN {ret} > 0 THEN 1.0 WHEN {ret} < 0 THEN 0.0 END)", "win_rate"),
        ]
    )


_POS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.REGIME_POSITION.items())
CURVE_SQL = sp.FEATURED + f""",
cv_a AS (SELECT *, CASE regime {_POS} ELSE 0.0 END AS raw_position, coalesce({sp.change('adj_close', 1)}, 0) AS asset_return,
         coalesce({sp.change('px_spy', 1)}, 0) AS benchmark_return FROM featured),
cv_b AS (SELECT *, greatest(0.0, least(1.0, coalesce(lag(raw_position) {OVER}, 0))) AS position FROM cv_a),
cv_c AS (SELECT *, abs(position - coalesce(lag(position) {OVER}, 0)) AS turnover FROM cv_b),
cv_d AS (SELECT *, position * asset_return - turnover * 0.0007 AS strategy_return, asset_return AS buy_hold_return FROM cv_c),
curve AS MATERIALIZED (SELECT *, {", ".join(f"product(1 + {p}_return) {SO_FAR} AS {p}_equity" for p in ("strategy", "buy_hold", "benchmark"))} FROM cv_d)"""
BOOKS = (("Strategy", "strategy"), ("Buy & Hold", "buy_hold"), ("Benchmark", "benchmark"))
_BOOK_SQL = " UNION ALL ".join(
    f"""SELECT ticker, '{label}' AS book, {perf_sql(p + '_return', 'dd')},
  {r('sum(turnover)' if p == 'strategy' else 'CAST(NULL AS DOUBLE)', 'turnover')},
  {r('avg(CAST(position > 0 AS DOUBLE))' if p == 'strategy' else 'CAST(NULL AS DOUBLE)', 'exposure')}
  FROM (SELECT *, {p}_equity / max({p}_equity) {SO_FAR} - 1 AS dd FROM curve) GROUP BY ticker"""
    for label, p in BOOKS
)


@query("regime_backtest", sp.with_(CURVE_SQL, _BOOK_SQL))
def regime_backtest(spark, sf):
    return shown(bt.summarize(bt.regime_curve(fx.featured(spark, sf), "SPY")))


CURVE_COLUMNS = "raw_position, position, turnover, strategy_return, strategy_equity, buy_hold_equity, benchmark_equity"


@query("backtest_curve", sp.with_(CURVE_SQL, f"SELECT ticker, date, {rs(CURVE_COLUMNS)} FROM curve"))
def backtest_curve(spark, sf):
    return shown(bt.regime_curve(fx.featured(spark, sf), "SPY"), "ticker", "date", *CURVE_COLUMNS.split(", "))


_EXPOSURE = f"({sp.raw_weight('100 * greatest(0, least(1, 1 / (1 + exp(-20 * return_20d))))', '1 / (1 + exp(-10 * (volatility_20d - 0.42)))', 'regime')}) / 0.12"
_SIG = {
    "sig_hold": "1.0",
    "sig_sma200": "CASE WHEN adj_close > ma_200d THEN 1.0 ELSE 0.0 END",
    "sig_cross": "CASE WHEN ma_50d > ma_200d THEN 1.0 ELSE 0.0 END",
    "sig_without_ml": sp.multiplier().replace("ELSE 0.5", "ELSE 0.0"),
    "sig_with_ml": f"CASE WHEN return_20d IS NOT NULL AND volatility_20d IS NOT NULL THEN {_EXPOSURE} ELSE 0.0 END",
    "sig_trend": "CASE WHEN dist_ma_50d > 0 AND dist_ma_200d > 0 THEN 1.0 ELSE 0.0 END",
    "sig_trend_risk": "CASE WHEN dist_ma_50d > 0 AND dist_ma_200d > 0 AND max_drawdown_60d > -0.12 AND max_drawdown_120d > -0.20 THEN 1.0 ELSE 0.0 END",
    "sig_trend_loose": "CASE WHEN (coalesce(dist_ma_50d, 0) > 0 OR coalesce(dist_ma_200d, 0) > 0) AND max_drawdown_120d > -0.20 THEN 1.0 ELSE 0.0 END",
}
_UNION = " UNION ALL ".join(
    f"SELECT ticker, date, adj_close, {i} AS strategy_order, '{s}' AS strategy, {_SIG[bt.SIGNALS[s]]} AS signal FROM featured"
    for i, s in enumerate(bt.STRATEGIES)
)
OS = "OVER (PARTITION BY ticker, strategy ORDER BY date)"
OSF = "OVER (PARTITION BY ticker, strategy ORDER BY date ROWS UNBOUNDED PRECEDING)"
GRID_SQL = sp.FEATURED + f""",
g_s AS MATERIALIZED ({_UNION}),
g_a AS (SELECT *, greatest(0.0, least(1.0, coalesce(lag(signal) {OS}, 0))) AS position,
        coalesce(adj_close / lag(adj_close) {OS} - 1, 0) AS ar FROM g_s),
g_b AS (SELECT *, abs(position - coalesce(lag(position) {OS}, 0)) AS turnover, position * ar AS sr FROM g_a),
g_c AS (SELECT *, 1000 * product(1 + sr) {OSF} AS eq FROM g_b),
g_d AS (SELECT *, max(eq) {OSF} AS peak FROM g_c),
g_e AS MATERIALIZED (SELECT *, eq / peak - 1 AS dd, last_value(CASE WHEN is_high THEN date END IGNORE NULLS) {OSF} AS peak_date
  FROM (SELECT *, round(peak, 6) > coalesce(lag(round(peak, 6)) {OS}, '-inf'::DOUBLE) AS is_high FROM g_d)),
grid AS MATERIALIZED (SELECT ticker, strategy, CAST(max(strategy_order) AS BIGINT) AS strategy_order, round(max_by(eq, date), 6) AS final_value,
  round(max_by(eq, date), 6) / 1000 - 1 AS total_return, pow(product(1 + sr), 252.0 / count(sr)) - 1 AS annualized_return, round(min(dd), 9) AS max_drawdown,
  CAST(sum(CAST(turnover > 1e-12 AS INT)) AS BIGINT) AS number_of_trades, CAST(sum(CAST(position > 0 AS INT)) AS BIGINT) AS days_in_market,
  avg(CAST(position > 0 AS DOUBLE)) AS percent_days_in_market, arg_min(peak_date, (round(dd, 9), date)) AS worst_drawdown_start, arg_min(date, (round(dd, 9), date)) AS worst_drawdown_end
  FROM g_e GROUP BY ticker, strategy)"""


def _grid(spark, sf):
    featured = fx._pseudo(fx.featured(spark, sf))
    exposure = al.raw_weight(100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p_out"))), F.col("p_risk"), F.col("regime"), al.Limits()) / 0.12
    known = F.col("p_out").isNotNull() & F.col("p_risk").isNotNull()
    signals = bt.with_score_signal(bt.with_rule_signals(featured.withColumn("exposure", F.when(known, exposure))), "exposure")
    return bt.strategy_grid(signals)


@query(
    "strategy_grid",
    sp.with_(
        GRID_SQL,
        f"""SELECT ticker, strategy, strategy_order, {rs('final_value, total_return, annualized_return, max_drawdown')}, number_of_trades,
  days_in_market, {rs('percent_days_in_market')}, worst_drawdown_start, worst_drawdown_end FROM grid""",
    ),
)
def strategy_grid(spark, sf):
    return shown(_grid(spark, sf))


FLAGS_SQL = GRID_SQL + f""",
fl_v AS (SELECT *, {", ".join(f"max(CASE WHEN strategy = '{s}' THEN {c} END) OVER (PARTITION BY ticker) AS {n}" for s, c, n in (
    (bt.PRODUCTION, "final_value", "pv"), (bt.BUY_HOLD, "final_value", "hv"), (bt.SMA200, "final_value", "sv"), (bt.WITH_ML, "final_value", "wv"),
    (bt.WITHOUT_ML, "final_value", "ov"), (bt.PRODUCTION, "total_return", "pt"), (bt.PRODUCTION, "max_drawdown", "pd")))} FROM grid),
fl_t AS (SELECT *, CASE WHEN abs(max_drawdown) <= 1e-12 THEN CASE WHEN total_return > 0 THEN 'inf'::DOUBLE ELSE total_return END ELSE total_return / abs(max_drawdown) END AS tr,
  CASE WHEN abs(pd) <= 1e-12 THEN CASE WHEN pt > 0 THEN 'inf'::DOUBLE ELSE pt END ELSE pt / abs(pd) END AS ptr FROM fl_v),
flags AS MATERIALIZED (SELECT ticker, strategy,
  first_value(strategy) OVER (PARTITION BY ticker ORDER BY final_value DESC, strategy_order) AS best_strategy_per_ticker,
  first_value(strategy) OVER (PARTITION BY ticker ORDER BY final_value, strategy_order) AS worst_strategy_per_ticker,
  final_value > hv AS beats_buy_hold, final_value > sv AS beats_200dma, total_return > pt AND tr > ptr AS improves_return_drawdown_tradeoff_vs_production,
  pv > hv AS production_beats_buy_hold, pv > sv AS production_beats_200dma, wv > ov AS ml_adds_value_vs_non_ml_app_rule FROM fl_t)"""
FLAG_COLUMNS = (
    "ticker, strategy, best_strategy_per_ticker, worst_strategy_per_ticker, beats_buy_hold, beats_200dma, "
    "improves_return_drawdown_tradeoff_vs_production, production_beats_buy_hold, production_beats_200dma, ml_adds_value_vs_non_ml_app_rule"
)


@query("roi_flags", sp.with_(FLAGS_SQL, f"SELECT {FLAG_COLUMNS} FROM flags"))
def roi_flags(spark, sf):
    return shown(bt.comparison_flags(_grid(spark, sf)), *FLAG_COLUMNS.split(", "))


def _n(condition: str, name: str) -> str:
    return f"CAST(coalesce(sum(CAST({condition} AS INT)), 0) AS BIGINT) AS {name}"


_P = f"strategy = '{bt.PRODUCTION}'"
_S = "strategy IN (" + ", ".join(f"'{s}'" for s in bt.SIMPLE) + ")"


@query(
    "roi_rollup",
    sp.with_(
        FLAGS_SQL,
        f"""SELECT {_n(f'{_P} AND production_beats_buy_hold', 'production_beats_buy_hold_count')}, {_n(_P, 'production_test_count')},
  {_n(f'{_P} AND production_beats_200dma', 'production_beats_200dma_count')}, {_n(f'{_P} AND ml_adds_value_vs_non_ml_app_rule', 'ml_adds_value_count')},
  {_n(_P, 'ml_test_count')}, {_n(f'{_S} AND beats_buy_hold', 'simple_rules_beats_buy_hold_count')}, {_n(_S, 'simple_rule_test_count')},
  {_n(f'{_S} AND beats_200dma', 'simple_rules_beats_200dma_count')},
  {_n(f'{_S} AND improves_return_drawdown_tradeoff_vs_production', 'simple_rules_improve_tradeoff_vs_production_count')} FROM flags""",
    ),
)
def roi_rollup(spark, sf):
    return bt.roll_up(bt.comparison_flags(_grid(spark, sf)))


@query(
    "probability_signal",
    sp.with_(
        sp.SCORES,
        """SELECT ticker, date, CASE WHEN probability_out >= 0.6 AND probability_risk < 0.4 THEN 1.0 WHEN probability_out >= 0.6 THEN 0.25 ELSE 0.0 END::DOUBLE AS signal FROM scores""",
    ),
)
def probability_signal(spark, sf):
    s = fx.scores(spark, sf)
    return s.select("ticker", "date", bt.probability_signal(F.col("probability_out"), F.col("probability_risk")).alias("signal"))


REBALANCE_SQL = sp.REGIME_SCORES + f""",
reb AS MATERIALIZED (SELECT max(date) AS rebalance_date FROM days GROUP BY date_trunc('month', date)),
latest_at AS MATERIALIZED (SELECT r.rebalance_date, s.* FROM reb r JOIN scores s ON s.date <= r.rebalance_date
  QUALIFY row_number() OVER (PARTITION BY r.rebalance_date, s.ticker ORDER BY s.date DESC) = 1),
al_r AS (SELECT *, {sp.raw_weight('ml_score', 'probability_risk', 'regime')} AS raw_target_weight FROM latest_at),
al_g AS (SELECT *, sum(raw_target_weight) OVER (PARTITION BY rebalance_date) AS gross FROM al_r),
al_w AS (SELECT *, raw_target_weight * CASE WHEN gross > 0.9 THEN 0.9 / gross ELSE 1.0 END AS target_weight FROM al_g),
bm AS (SELECT date, price, price / nullif(avg(price) OVER (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 0) - 1 AS dist,
   price / lag(price, 60) OVER (ORDER BY date) - 1 AS r60, count(*) OVER (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS n FROM bench WHERE symbol = 'SPY'),
bmr AS (SELECT rebalance_date, arg_max(coalesce(CASE WHEN n = 200 THEN dist END < 0, false) OR coalesce(r60 < 0, false), date) AS weak,
   arg_max(price, date) AS px FROM reb JOIN bm ON bm.date <= rebalance_date GROUP BY 1),
bmd AS (SELECT rebalance_date, weak, px / max(px) OVER (ORDER BY rebalance_date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM bmr),
gd_a AS (SELECT a.*, weak, drawdown, target_weight * CASE WHEN weak THEN 0.5 ELSE 1 END * CASE WHEN drawdown <= -0.15 THEN 0.5 ELSE 1 END AS cut
  FROM al_w a JOIN bmd USING (rebalance_date)),
gd_b AS (SELECT *, sum(cut) OVER (PARTITION BY rebalance_date) AS cut_gross FROM gd_a),
weights AS MATERIALIZED (SELECT ticker, rebalance_date, date AS score_date, raw_target_weight, target_weight,
   cut * CASE WHEN cut_gross > 0.9 THEN 0.9 / cut_gross ELSE 1.0 END AS weight,
   concat_ws(', ', CASE WHEN weak THEN 'benchmark downtrend de-risking' END, CASE WHEN drawdown <= -0.15 THEN 'portfolio drawdown de-risking' END,
     CASE WHEN cut_gross > 0.9 THEN 'gross exposure cap' END) AS risk_control_flags FROM gd_b)"""


def _weights(spark, sf):
    """Monthly targets after guardrails; the drawdown input is the benchmark's own."""
    from pyspark.sql import Window

    days = fx.shipping_days(spark, sf)
    reb = al.rebalance_dates(days, "monthly")
    scores = fx.scores(spark, sf, regimes=True).drop("volatility_60d")
    asof = al.latest_scores_at(scores, reb)
    targets = settle(al.allocate(asof, by=["rebalance_date"]))
    w = Window.orderBy("date")
    spy = fx.benchmarks(spark, sf).filter("symbol = 'SPY'").select("date", "price")
    spy = spy.withColumns(
        {
            "dist": F.when(F.count("price").over(w.rowsBetween(-199, 0)) == 200, F.col("price") / F.avg("price").over(w.rowsBetween(-199, 0)) - 1),
            "r60": F.col("price") / F.lag("price", 60).over(w) - 1,
        }
    )
    at = (
        spy.join(F.broadcast(reb), F.col("date") <= F.col("rebalance_date"))
        .groupBy("rebalance_date")
        .agg(F.max_by(F.struct("price", al.is_downtrend(F.lit(""), F.col("dist"), F.col("r60")).alias("weak")), "date").alias("b"))
    )
    so_far = Window.orderBy("rebalance_date").rowsBetween(Window.unboundedPreceding, 0)
    at = at.select("rebalance_date", F.col("b.weak").alias("weak"), (F.col("b.price") / F.max("b.price").over(so_far) - 1).alias("drawdown"))
    guarded = al.guardrails(targets.join(F.broadcast(at), "rebalance_date"), F.col("weak"), F.col("drawdown"))
    return guarded.withColumn("weight", F.col("adjusted_weight")).withColumn("score_date", F.col("date"))


@query(
    "allocation",
    sp.with_(REBALANCE_SQL, f"SELECT ticker, rebalance_date, score_date, {rs('raw_target_weight, target_weight, weight', digits=9)}, risk_control_flags FROM weights"),
)
def allocation(spark, sf):
    out = _weights(spark, sf).select("ticker", "rebalance_date", "score_date", "raw_target_weight", "target_weight", "weight", "risk_control_flags")
    return shown(out, digits=9)


_MULTIPLIER = "CASE regime " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.REGIME_MULTIPLIER.items()) + f" ELSE {fixed.UNKNOWN_REGIME_MULTIPLIER} END"


@query(
    "volatility_allocation",
    sp.with_(
        sp.REGIME_SCORES + f""",
va_a AS (SELECT *, {sp.raw_weight('ml_score', 'probability_risk', 'regime')} AS x, CASE WHEN volatility_20d > 0 THEN least(1.0, 0.25 / volatility_20d) END AS adj FROM scores),
va_b AS (SELECT *, CASE WHEN x * coalesce(adj, 1.0) < 0.01 THEN 0.0 ELSE x * coalesce(adj, 1.0) END AS raw FROM va_a),
va_c AS (SELECT *, sum(raw) OVER (PARTITION BY date) AS gross FROM va_b)""",
        f"""SELECT ticker, date, {r('raw', 'raw_target_weight', 9)}, {r('raw * CASE WHEN gross > 0.9 THEN 0.9 / gross ELSE 1.0 END', 'target_weight', 9)}, concat(ticker, ': score ', CAST(CAST(round(ml_score) AS BIGINT) AS VARCHAR),
  CASE WHEN probability_risk >= 0.6 THEN '; high drawdown risk' WHEN probability_risk >= 0.4 THEN '; moderate drawdown risk' ELSE '' END, '; regime multiplier ', printf('%.2f', {_MULTIPLIER}),
  CASE WHEN adj IS NOT NULL THEN '; volatility adjustment ' || printf('%.2f', adj) ELSE '' END, CASE WHEN gross > 0.9 THEN '; scaled to exposure cap 90%' ELSE '' END) AS allocation_explanation FROM va_c""",
    ),
)
def volatility_allocation(spark, sf):
    """Targets under a volatility target of 25 %, with their explanation."""
    scores = fx.scores(spark, sf, regimes=True).drop("volatility_60d").withColumnRenamed("volatility_20d", "volatility_60d")
    out = al.allocate(settle(scores), al.Limits(volatility_target=0.25), by=["date"])
    return shown(out, "ticker", "date", "raw_target_weight", "target_weight", "allocation_explanation", digits=9)


PORTFOLIO_SQL = REBALANCE_SQL + f""",
held AS MATERIALIZED (SELECT d.date, max(r.rebalance_date) AS rebalance_date FROM days d LEFT JOIN (SELECT DISTINCT rebalance_date FROM weights) r ON r.rebalance_date < d.date GROUP BY 1),
held2 AS MATERIALIZED (SELECT date, lag(rebalance_date) OVER (ORDER BY date) AS rebalance_date FROM held),
rets AS MATERIALIZED (SELECT ticker, date, coalesce({sp.change('adj_close', 1)}, 0) AS ret FROM bars),
pos AS MATERIALIZED (SELECT b.ticker, b.date, b.ret, coalesce(w.weight, 0) AS weight FROM rets b JOIN held h USING (date) LEFT JOIN weights w ON w.ticker = b.ticker AND w.rebalance_date = h.rebalance_date),
pos2 AS MATERIALIZED (SELECT b.ticker, b.date, b.ret, coalesce(w.weight, 0) AS weight FROM rets b JOIN held2 h USING (date) LEFT JOIN weights w ON w.ticker = b.ticker AND w.rebalance_date = h.rebalance_date),
contrib AS MATERIALIZED (SELECT ticker, sum(weight * ret) AS return_contribution, sum(CASE WHEN weight * ret < 0 THEN weight * ret ELSE 0 END) AS downside_contribution FROM pos2 GROUP BY 1),
rcal AS (SELECT rebalance_date, lag(rebalance_date) OVER (ORDER BY rebalance_date) AS prev FROM (SELECT DISTINCT rebalance_date FROM weights)),
both_w AS (SELECT ticker, rebalance_date, weight AS w, 0.0 AS was FROM weights UNION ALL
           SELECT w.ticker, c.rebalance_date, 0.0, w.weight FROM weights w JOIN rcal c ON c.prev = w.rebalance_date),
rstat AS (SELECT rebalance_date, sum(w) AS gross_exposure, CAST(sum(CAST(w > 0 AS INT)) AS BIGINT) AS holdings, sum(abs(w - was)) AS traded
  FROM (SELECT ticker, rebalance_date, sum(w) AS w, sum(was) AS was FROM both_w GROUP BY 1, 2) GROUP BY 1),
pc_a AS (SELECT h.date, h.rebalance_date, coalesce(g.gross_return, 0) AS gross_return, coalesce(s.gross_exposure, 0) AS gross_exposure, coalesce(s.holdings, 0) AS holdings,
  CASE WHEN h.rebalance_date IS DISTINCT FROM lag(h.rebalance_date) OVER (ORDER BY h.date) THEN coalesce(s.traded, 0) ELSE 0 END AS turnover
  FROM held h LEFT JOIN (SELECT date, sum(weight * ret) AS gross_return FROM pos GROUP BY 1) g USING (date) LEFT JOIN rstat s ON s.rebalance_date = h.rebalance_date),
pc_b AS (SELECT *, gross_return - turnover * 0.0007 AS portfolio_return, 1 - gross_exposure AS cash FROM pc_a),
pcurve AS MATERIALIZED (SELECT *, product(1 + portfolio_return) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS portfolio_equity FROM pc_b)"""
PF_COLUMNS = "gross_return, gross_exposure, turnover, portfolio_return, cash, portfolio_equity"


def _portfolio(spark, sf):
    weights = settle(_weights(spark, sf).select("ticker", "rebalance_date", "weight"))
    return fx.bars(spark, sf), fx.shipping_days(spark, sf), weights


@query("portfolio_returns", sp.with_(PORTFOLIO_SQL, f"SELECT date, holdings, {rs(PF_COLUMNS, digits=8)} FROM pcurve"))
def portfolio_returns(spark, sf):
    return shown(al.portfolio_curve(*_portfolio(spark, sf), capital=1.0), "date", "holdings", *PF_COLUMNS.split(", "), digits=8)


@query("contribution", sp.with_(PORTFOLIO_SQL, f"SELECT ticker, {rs('return_contribution, downside_contribution')} FROM contrib"))
def contribution(spark, sf):
    return shown(al.contribution(al.positions(*_portfolio(spark, sf), lag=2)))


@query(
    "portfolio_summary",
    sp.with_(
        PORTFOLIO_SQL,
        f"""SELECT {perf_sql('portfolio_return', 'dd').replace('AS win_rate', 'AS hit_rate')}, {r('sum(turnover)', 'turnover')}, {r('avg(cash)', 'average_cash')},
  {r('avg(gross_exposure)', 'average_exposure')}, {r('avg(holdings)', 'average_holdings')},
  (SELECT arg_max(ticker, (return_contribution, ticker)) FROM contrib) AS top_contributor,
  {r('(pow(product(1 + portfolio_return), 252.0 / count(*)) - 1) / nullif(abs(min(dd)), 0)', 'calmar')}
  FROM (SELECT *, portfolio_equity / max(portfolio_equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM pcurve)""",
    ),
)
def portfolio_summary(spark, sf):
    bars, days, weights = _portfolio(spark, sf)
    curve = al.portfolio_curve(bars, days, weights, capital=1.0)
    return shown(al.portfolio_summary(curve, al.contribution(al.positions(bars, days, weights, lag=2))))


@query(
    "rebalance_calendar",
    sp.with_(
        sp.FOLDS,
        "SELECT 'monthly' AS frequency, max(date) AS rebalance_date FROM days GROUP BY date_trunc('month', date) "
        "UNION ALL SELECT 'weekly', max(date) FROM days GROUP BY date_trunc('week', date)",
    ),
)
def rebalance_calendar(spark, sf):
    days = fx.shipping_days(spark, sf)
    parts = [al.rebalance_dates(days, f).select(F.lit(f).alias("frequency"), "rebalance_date") for f in ("monthly", "weekly")]
    return parts[0].unionByName(parts[1])
