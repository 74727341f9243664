"""Model fitting (rows only) and target tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom import fixed
from tickerloom.operators import audits as au
from tickerloom.operators import challenge as ch
from tickerloom.operators import folds as fo
from tickerloom.operators import labels as lb
from tickerloom.operators import metrics as mt
from tickerloom.operators import models as md
from tickerloom.operators import robustness as rb
from tickerloom.operators import scorecards as sc
from tickerloom.operators import targets as tg
from tickerloom.operators import transforms as tr
from tickerloom.plans.storage import passing, settle, stored
from workload import fixtures as fx
from workload import sqlparts as sp
from workload.q_features import TARGET_SQL
from workload.q_scores import metrics_sql, rank_bucket_sql
from workload.registry import ORACLES, QUERIES, query, r, rs, shown


#: What the model queries read of the panel beside features and labels.
BESIDE = ("ticker", "date", "adj_close", "regime", "risk_flags", "forward_20d_return", "forward_20d_excess_return", "forward_20d_drawdown")


def _full_panel(spark, sf):
    """Technical, Fourier and wavelet features, regime and labels on one frame."""
    panel = tr.waves(fx.panel(spark, sf))
    labels = ("label_outperform_20d", "label_drawdown_risk_20d")
    return stored(panel.select(*BESIDE, *labels, *au.known_features(panel)))


def _validated(spark, sf, *labels, kind="logistic_regression", **options):
    """``(predictions, importance)`` of each label over all usable features, in the default windows, fitted together."""
    panel = _full_panel(spark, sf)
    columns = tuple(au.feature_columns(panel))
    out, strengths = md.validate_many(panel, [md.Run(columns, c, kind, tags=(("label", c),)) for c in labels], **options)
    return [tuple(df.filter(F.col("label") == c).drop("label") for df in (out, strengths)) for c in labels]


@query("walk_forward_predictions")
def walk_forward_predictions(spark, sf):
    [(out, _)] = _validated(spark, sf, "label_outperform_20d")
    return shown(mt.binary_metrics(out, ["fold"], "actual", "probability"))


@query("walk_forward_importance")
def walk_forward_importance(spark, sf):
    [(_, strengths)] = _validated(spark, sf, "label_drawdown_risk_20d")
    return shown(strengths)


@query("model_selection")
def model_selection(spark, sf):
    """Per-fold choice between the four candidates in their production sizes."""
    [(out, _)] = _validated(spark, sf, "label_drawdown_risk_20d", kind="auto")
    folds = mt.binary_metrics(out, ["fold", "selected_model"], "actual", "probability").withColumn("target", F.lit("drawdown_risk"))
    return shown(md.selection_summary(folds))


def _groups(panel):
    return {g: au.feature_columns(panel, g) for g in tg.GROUP_ORDER}


@query("feature_group_comparison")
def feature_group_comparison(spark, sf):
    """The four feature groups, redundant transforms pruned, over the same folds."""
    panel = _full_panel(spark, sf)
    return shown(md.compare_groups(panel, _groups(panel), "label_drawdown_risk_20d"))


@query("ablation")
def ablation(spark, sf):
    """Conclusion per feature group and the rule-only row."""
    panel = _full_panel(spark, sf)
    return shown(md.ablation(panel, _groups(panel), "label_outperform_20d"))


@query("score_history")
def score_history(spark, sf):
    """Both targets scored over history including unlabelled rows, merged and bucketed."""
    parts = [out for out, _ in _validated(spark, sf, "label_outperform_20d", "label_drawdown_risk_20d", open_end=True)]
    merged = md.merge_predictions(*parts)
    return shown(merged.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("ml_score").alias("mean_score"), F.avg("probability_risk").alias("mean_risk")))


@query("current_scores")
def current_scores(spark, sf):
    panel = _full_panel(spark, sf)
    return shown(md.current_scores(panel, panel, au.feature_columns(panel)))


def _robustness(spark, sf):
    """Every named axis with several values; the day loop's equity feedback is not part of the portfolio."""
    features = stored(tr.waves(fx.featured(spark, sf)))
    return settle(rb.grid(features, _groups(features), fx.bars(spark, sf), fx.shipping_days(spark, sf), horizons=(20, 60), trains=(252, 504)))


@query("robustness_cases")
def robustness_cases(spark, sf):
    """Metrics of every case of refits over benchmark, horizon, feature group, thresholds and training window."""
    return shown(_robustness(spark, sf))


@query("robustness_grid")
def robustness_grid(spark, sf):
    """The same cases, summarized by the portfolio's metric."""
    cases = _robustness(spark, sf)
    return shown(md.robustness(cases, rb.metric_of(cases)))


TARGET_LABELS = {
    "outperform_20d": "label_outperform_20d",
    "outperform_60d": "label_outperform_60d",
    "risk_adjusted_excess_20d": "label_risk_adjusted_excess_20d",
    "top_tercile_excess_20d": "label_top_tercile_excess_20d",
    "tail_adjusted_outperform_20d": "label_tail_adjusted_outperform_20d",
    "pullback_recovery_20d": "label_pullback_recovery_20d",
}
_PRED = " UNION ALL ".join(
    f"SELECT '{t}' AS target_id, f.fold, t.date, t.ticker, {c} AS actual, round(1 / (1 + exp(-20 * return_20d)), 12) AS probability, g.regime FROM targets t JOIN folds f ON t.date BETWEEN f.test_start AND f.test_end JOIN featured g USING (ticker, date) WHERE {c} IS NOT NULL AND return_20d IS NOT NULL".replace("return_20d", "t.return_20d")
    for t, c in TARGET_LABELS.items()
)
_BALANCE = " UNION ALL ".join(f"SELECT '{t}' AS target_id, {c} AS y, forward_20d_excess_return AS e, forward_20d_drawdown AS d FROM targets WHERE {c} IS NOT NULL" for t, c in TARGET_LABELS.items())
BALANCE_PART = f""",
tb_u AS ({_BALANCE}),
tbal AS MATERIALIZED (SELECT *, CASE WHEN rate < 0.05 OR rate > 0.95 THEN 'Unusable' WHEN rate < 0.2 OR rate > 0.8 THEN 'Skewed' ELSE 'Healthy' END AS class_balance_status FROM (
  SELECT target_id, count(*) AS n, avg(y) AS rate, avg(e) FILTER (y = 1) AS ep, avg(e) FILTER (y = 0) AS en, avg(d) FILTER (y = 1) AS dp, avg(d) FILTER (y = 0) AS dn FROM tb_u GROUP BY 1))"""
PRED_SQL = sp.FEATURED + TARGET_SQL[len(sp.ALIGNED):] + "," + sp.FOLDS + f""",
pred AS MATERIALIZED ({_PRED})"""


def _bucket_sql(name: str, by: str) -> str:
    return f"""
{name} AS (SELECT {by}, count(*) FILTER (b = 2) AS tc, count(*) FILTER (b = 0) AS bc, CASE WHEN count(*) FILTER (b = 2) >= 5 AND count(*) FILTER (b = 0) >= 5 THEN avg(actual) FILTER (b = 2) END AS tr,
  CASE WHEN count(*) FILTER (b = 2) >= 5 AND count(*) FILTER (b = 0) >= 5 THEN avg(actual) FILTER (b = 0) END AS br FROM (SELECT *, {rank_bucket_sql(3, 'probability', by)} AS b FROM pred) GROUP BY {by})"""


def _targets(spark, sf):
    """What the target tables read of the panel; the features stay out of the stored rows."""
    keep = ["regime", "return_20d", "return_60d", "forward_20d_excess_return", "forward_20d_drawdown", *TARGET_LABELS.values()]
    rows = fx.featured(spark, sf, lambda rows: lb.candidate_labels(rows, "SPY"), keep)
    return lb.with_top_tercile(rows, keep=keep)


# Feature group -> the formula that stands for its model in the tables without random streams.
GROUP_FORMULAS = {"technical": "-20 * return_20d", "technical_fourier": "-10 * return_60d", "all": "20 * return_20d"}


def _any_known():
    return F.coalesce(*TARGET_LABELS.values()).isNotNull()


def _group_predictions(spark, sf, panel):
    tested = fo.assign(panel, fx.fold_bounds(spark, sf), "test", fx.shipping_days(spark, sf))
    groups = F.array(*[F.struct(F.lit(g).alias("feature_group"), F.round(1 / (1 + F.exp(F.expr(x))), 12).alias("probability")) for g, x in GROUP_FORMULAS.items()])
    rows = tested.filter(_any_known()).select("fold", "date", "ticker", *TARGET_LABELS.values(), F.inline(groups))
    return tg.Shared(stored(rows.filter("probability IS NOT NULL")), TARGET_LABELS)


def _predictions(spark, sf, panel):
    tested = fo.assign(panel, fx.fold_bounds(spark, sf), "test", fx.shipping_days(spark, sf))
    p = F.round(1 / (1 + F.exp(-20 * F.col("return_20d"))), 12)
    rows = tested.filter(_any_known()).select("fold", "date", "ticker", "regime", p.alias("probability"), *TARGET_LABELS.values())
    return tg.Shared(stored(rows.filter("probability IS NOT NULL")), TARGET_LABELS)


@query(
    "target_balance",
    sp.with_(
        TARGET_SQL + BALANCE_PART,
        f"""SELECT target_id, n AS sample_count, {r('rate', 'positive_rate')}, class_balance_status, {r('ep', 'mean_forward_excess_return_when_positive')}, {r('en', 'mean_forward_excess_return_when_negative')},
  {r('dp', 'mean_forward_drawdown_when_positive')}, {r('dn', 'mean_forward_drawdown_when_negative')}, n < 50 AS too_few_samples, rate < 0.05 AS too_rare_positive_class, rate > 0.95 AS too_common_positive_class FROM tbal""",
    ),
)
def target_balance(spark, sf):
    return shown(tg.balance(settle(lb.target_candidates(fx.light(spark, sf), "SPY")), TARGET_LABELS))


WALK_PART = "," + metrics_sql("m", "pred", "target_id", "actual", "probability") + "," + _bucket_sql("tk", "target_id") + "," + _bucket_sql("tt", "target_id, ticker") + """,
pk AS MATERIALIZED (SELECT *, target_id || '|' || fold AS k FROM pred),""" + metrics_sql("mf", "pk", "k", "actual", "probability") + """,
wf AS (SELECT target_id, arg_min(fold, (round(auc, 12), fold)) AS worst_fold, min(round(auc, 12)) AS worst_fold_roc_auc FROM (SELECT DISTINCT k, target_id, fold FROM pk) JOIN mf USING (k) WHERE auc IS NOT NULL GROUP BY 1),
wt AS (SELECT target_id, arg_min(ticker, (round(tr - br, 12), ticker)) AS worst_ticker, min(round(tr - br, 12)) AS worst_ticker_bucket_spread FROM tt WHERE tr IS NOT NULL GROUP BY 1),
walk AS MATERIALIZED (SELECT m.target_id, n AS prediction_count, (SELECT count(DISTINCT fold) FROM pred p WHERE p.target_id = m.target_id) AS folds, rate, auc, ap, brier, rate - mp AS gap, tr, br, tr - br AS spread, tc, bc, worst_fold, worst_fold_roc_auc, worst_ticker, worst_ticker_bucket_spread,
  CASE WHEN auc >= 0.55 OR ap - rate >= 0.05 OR tr - br >= 0.1 THEN 'Promising' WHEN auc < 0.52 AND ap - rate < 0.03 AND tr - br < 0.05 THEN 'Weak' ELSE 'Mixed' END AS quality_summary
  FROM m JOIN tk USING (target_id) JOIN wf USING (target_id) JOIN wt USING (target_id))"""


@query(
    "target_walk_forward",
    sp.with_(
        PRED_SQL + WALK_PART,
        f"""SELECT target_id, prediction_count, folds, {r('rate', 'positive_rate')}, {r('auc', 'roc_auc')}, {r('ap', 'pr_auc')}, {r('brier', 'brier_score')}, {r('gap', 'calibration_gap')}, {r('tr', 'top_bucket_positive_rate')}, {r('br', 'bottom_bucket_positive_rate')},
  {r('spread', 'bucket_spread')}, tc AS top_bucket_count, bc AS bottom_bucket_count, worst_fold, {rs('worst_fold_roc_auc')}, worst_ticker, {rs('worst_ticker_bucket_spread')}, quality_summary FROM walk""",
    ),
)
def target_walk_forward(spark, sf):
    out = tg.walk_forward_table(_predictions(spark, sf, _targets(spark, sf)))
    return shown(
        out, "target_id", "prediction_count", "folds", "positive_rate", "roc_auc", "pr_auc", "brier_score", "calibration_gap", "top_bucket_positive_rate", "bottom_bucket_positive_rate",
        "bucket_spread", "top_bucket_count", "bottom_bucket_count", "worst_fold", "worst_fold_roc_auc", "worst_ticker", "worst_ticker_bucket_spread", "quality_summary",
    )


@query(
    "target_fold_calibration",
    sp.with_(
        PRED_SQL + "," + _bucket_sql("tf", "target_id, fold"),
        f"""SELECT target_id, fold, count(*) AS sample_count, {r('avg(actual)', 'event_rate')}, {r('avg(probability)', 'mean_predicted_probability')}, {r('avg(actual) - avg(probability)', 'calibration_gap')}, any_value(tc) AS top_bucket_count, any_value(bc) AS bottom_bucket_count
  FROM pred JOIN tf USING (target_id, fold) GROUP BY 1, 2""",
    ),
)
def target_fold_calibration(spark, sf):
    return shown(tg.fold_calibration(_predictions(spark, sf, _targets(spark, sf))))


REGIME_PART = """,
pr AS MATERIALIZED (SELECT *, target_id || '|' || regime AS tkey FROM pred),""" + metrics_sql("mr", "pr", "tkey", "actual", "probability") + "," + _bucket_sql("tr_", "target_id, regime") + """,
reg AS MATERIALIZED (SELECT t.target_id, t.regime, n, rate, auc, ap, tr, br, tr - br AS spread, CASE WHEN n < 20 OR tr IS NULL THEN 'insufficient' WHEN tr - br >= 0.05 THEN 'positive' WHEN tr - br <= -0.05 THEN 'inverted' ELSE 'flat' END AS direction
  FROM tr_ t JOIN mr ON mr.tkey = t.target_id || '|' || t.regime)"""


@query(
    "target_regimes",
    sp.with_(PRED_SQL + REGIME_PART, f"SELECT target_id, regime, n AS sample_count, {r('rate', 'positive_rate')}, {r('auc', 'roc_auc')}, {r('ap', 'pr_auc')}, {r('spread', 'bucket_spread')}, direction FROM reg"),
)
def target_regimes(spark, sf):
    return shown(tg.regime_table(_predictions(spark, sf, _targets(spark, sf))), "target_id", "regime", "sample_count", "positive_rate", "roc_auc", "pr_auc", "bucket_spread", "direction")


QUALITY_PART = BALANCE_PART + WALK_PART + REGIME_PART + """,
rq AS (SELECT target_id, count(*) FILTER (direction = 'inverted') AS inv, CASE WHEN count(*) FILTER (direction <> 'insufficient') = 0 THEN 'Insufficient data' WHEN count(*) FILTER (direction = 'inverted') > 0 THEN 'Inverted in some regimes'
  WHEN count(*) FILTER (direction = 'positive') = count(*) FILTER (direction <> 'insufficient') THEN 'Stable across regimes' ELSE 'Regime-sensitive' END AS rs FROM reg GROUP BY 1),
q0 AS (SELECT b.target_id, b.n, b.rate AS brate, class_balance_status AS cb, auc, brier, gap, spread, inv, rs, CASE WHEN abs(gap) <= 0.05 AND brier <= 0.2 THEN 'Good' WHEN abs(gap) <= 0.1 AND brier <= 0.25 THEN 'Acceptable' ELSE 'Poor' END AS cq,
  CASE WHEN spread >= 0.05 THEN 'Positive' WHEN spread <= -0.05 THEN 'Inverted' ELSE 'Weak' END AS bq FROM tbal b JOIN walk USING (target_id) JOIN rq USING (target_id)),
q1 AS (SELECT *, CASE WHEN n < 50 OR cb = 'Unusable' THEN 'Unusable' WHEN bq = 'Inverted' OR auc < 0.5 OR inv > 1 THEN 'Weak' WHEN cb = 'Healthy' AND bq = 'Positive' AND cq <> 'Poor' AND rs IN ('Stable across regimes', 'Insufficient data') THEN 'Promising' ELSE 'Mixed' END AS q FROM q0),
q2 AS (SELECT a.*, b.q AS b_q, b.spread AS b_s, b.auc AS b_a, b.brier AS b_b, b.gap AS b_g, b.inv AS b_i FROM q1 a, (SELECT * FROM q1 WHERE target_id = 'outperform_20d') b),
q3 AS (SELECT *, CASE WHEN target_id = 'outperform_20d' THEN CASE WHEN q = 'Unusable' THEN 'Insufficient evidence' ELSE 'Keep baseline' END WHEN q = 'Unusable' THEN 'Reject for now' WHEN cb = 'Skewed' AND bq = 'Positive' THEN 'Special setup only'
  WHEN q = 'Promising' AND (b_q IN ('Weak', 'Unusable') OR spread >= b_s + 0.03 OR auc >= b_a + 0.02) THEN CASE WHEN rs = 'Inverted in some regimes' THEN 'Research-only candidate' ELSE 'Candidate for production trial' END WHEN q = 'Weak' THEN 'Reject for now' ELSE 'Research-only candidate' END AS status FROM q2),
qual AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY CASE q WHEN 'Promising' THEN 3 WHEN 'Mixed' THEN 2 WHEN 'Weak' THEN 1 ELSE 0 END DESC,
  CASE status WHEN 'Candidate for production trial' THEN 4 WHEN 'Keep baseline' THEN 3 WHEN 'Special setup only' THEN 2 WHEN 'Research-only candidate' THEN 1.5 WHEN 'Insufficient evidence' THEN 0.5 ELSE 0 END DESC,
  round(coalesce(spread, 0) + coalesce(auc - 0.5, 0), 9) DESC,
  CASE cq WHEN 'Good' THEN 2 WHEN 'Acceptable' THEN 1 WHEN 'Unavailable' THEN 0.5 ELSE 0 END + CASE rs WHEN 'Stable across regimes' THEN 2 WHEN 'Regime-sensitive' THEN 1 WHEN 'Insufficient data' THEN 0.5 ELSE 0 END + 0.5 DESC,
  target_id DESC) AS rank FROM q3)"""


def _quality(spark, sf):
    panel = _targets(spark, sf)
    predictions = _predictions(spark, sf, panel)
    tables = tg.curve_tables(predictions)
    return tg.quality(tg.balance(panel, TARGET_LABELS), tg.walk_forward_table(predictions, tables=tables), tg.regime_table(predictions, tables=tables))


@query(
    "target_quality",
    sp.with_(
        PRED_SQL + QUALITY_PART,
        "SELECT target_id, n AS sample_count, cb AS class_balance_status, rs AS regime_stability, inv AS regime_inversion_count, cq AS calibration_quality, bq AS bucket_separation_quality, q AS overall_target_quality, status AS production_candidate_status, rank AS candidate_rank FROM qual",
    ),
)
def target_quality(spark, sf):
    return shown(
        _quality(spark, sf), "target_id", "sample_count", "class_balance_status", "regime_stability", "regime_inversion_count", "calibration_quality", "bucket_separation_quality",
        "overall_target_quality", "production_candidate_status", "candidate_rank",
    )


@query(
    "target_stop_rule",
    sp.with_(
        PRED_SQL + QUALITY_PART,
        f"""SELECT target_id, {r('auc - b_a', 'roc_auc_delta')}, {r('brier - b_b', 'brier_score_delta')}, {r('spread - b_s', 'bucket_spread_delta')}, {r('abs(gap) - abs(b_g)', 'absolute_calibration_gap_delta')}, res AS stop_rule_result,
  CASE res WHEN 'baseline' THEN 'Current production target baseline for comparison.' WHEN 'pass' THEN 'Candidate clears the research stop rule versus the current baseline.' ELSE why END AS stop_rule_diagnosis,
  CASE WHEN res = 'baseline' THEN 'current baseline' WHEN auc IS NULL OR spread IS NULL THEN 'missing evidence fields' WHEN cause <> '' THEN cause WHEN res = 'fail' THEN 'mixed validation evidence' ELSE 'evidence clears stop rule' END AS likely_failure_cause,
  CASE WHEN res = 'baseline' THEN 'Continue' WHEN auc IS NULL OR spread IS NULL THEN 'Needs more data' WHEN res = 'pass' THEN 'Continue' WHEN cb = 'Unusable' THEN 'Kill' WHEN target_id = 'pullback_recovery_20d' THEN 'Hold as audit-only'
    WHEN thin THEN 'Needs more data' WHEN auc - b_a < -0.05 THEN 'Kill' ELSE 'Pivot' END AS recommended_decision
FROM (SELECT *, CASE WHEN target_id = 'outperform_20d' THEN 'baseline' WHEN why = '' THEN 'pass' ELSE 'fail' END AS res, concat_ws('; ', CASE WHEN thin THEN 'horizon mismatch / thin folds' END,
    CASE WHEN cb IN ('Skewed', 'Unusable') OR brate < 0.2 OR brate > 0.8 THEN 'target design / class imbalance' END, CASE WHEN abs(gap) > abs(b_g) + 0.03 THEN 'target noise / calibration' END,
    CASE WHEN inv > 0 AND worst_spread < 0 THEN 'regime inversion' END, CASE WHEN contains(why, 'bucket spread') THEN 'weak feature separation' END) AS cause
  FROM (SELECT q.*, contains(q.target_id, '60d') OR coalesce(w.folds < wb.folds, false) AS thin, (SELECT min(spread) FROM reg WHERE reg.target_id = q.target_id) AS worst_spread,
      concat_ws('; ', CASE WHEN q.spread IS NULL OR q.spread <= 0 THEN 'bucket spread is unavailable or non-positive' WHEN q.spread < b_s - 0.005 THEN 'bucket spread is worse than baseline tolerance' END,
        CASE WHEN q.brier > b_b + 0.02 THEN 'Brier score is worse than baseline tolerance' END, CASE WHEN abs(q.gap) > abs(b_g) + 0.03 THEN 'calibration gap is worse than baseline tolerance' END,
        CASE WHEN inv > b_i THEN 'regime inversion count is worse than baseline' END, CASE WHEN q IN ('Weak', 'Unusable') THEN 'overall target quality is ' || lower(q) END) AS why
    FROM qual q JOIN walk w USING (target_id), (SELECT folds FROM walk WHERE target_id = 'outperform_20d') wb))""",
    ),
)
def target_stop_rule(spark, sf):
    return shown(
        tg.stop_rule(_quality(spark, sf)), "target_id", "roc_auc_delta", "brier_score_delta", "bucket_spread_delta", "absolute_calibration_gap_delta", "stop_rule_result",
        "stop_rule_diagnosis", "likely_failure_cause", "recommended_decision",
    )


GROUP_SQL = ", gp AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{t}' AS target_id, '{g}' AS feature_group, '{t}|{g}' AS gk, f.fold, t.date, t.ticker, {c} AS actual, round(1 / (1 + exp({x.replace('return', 't.return')})), 12) AS probability FROM targets t JOIN folds f ON t.date BETWEEN f.test_start AND f.test_end JOIN featured USING (ticker, date) WHERE {c} IS NOT NULL AND t.{x.split('* ')[1]} IS NOT NULL"
    for t, c in TARGET_LABELS.items() for g, x in GROUP_FORMULAS.items()
) + ")," + metrics_sql("gm", "gp", "gk", "actual", "probability") + f""",
gb AS (SELECT gk, CASE WHEN count(*) FILTER (b = 2) >= 5 AND count(*) FILTER (b = 0) >= 5 THEN avg(actual) FILTER (b = 2) - avg(actual) FILTER (b = 0) END AS spread FROM (SELECT *, {rank_bucket_sql(3, 'probability', 'gk')} AS b FROM gp) GROUP BY 1),
gc AS MATERIALIZED (SELECT split_part(gk, '|', 1) AS target_id, split_part(gk, '|', 2) AS feature_group, n, rate, auc, ap, spread, coalesce(greatest(spread, (auc - 0.5) * 2, ap - rate), '-inf'::DOUBLE) AS s FROM gm JOIN gb USING (gk))"""


@query(
    "target_feature_groups",
    sp.with_(PRED_SQL + GROUP_SQL, f"SELECT target_id, feature_group, n AS prediction_count, {r('rate', 'positive_rate')}, {r('auc', 'roc_auc')}, {r('ap', 'pr_auc')}, {r('spread', 'bucket_spread')} FROM gc"),
)
def target_feature_groups(spark, sf):
    out = tg.group_comparison(_group_predictions(spark, sf, _targets(spark, sf)))
    return shown(out, "target_id", "feature_group", "prediction_count", "positive_rate", "roc_auc", "pr_auc", "bucket_spread")


@query(
    "target_stability",
    sp.with_(
        PRED_SQL + REGIME_PART + GROUP_SQL + """,
gd AS (SELECT *, CASE WHEN s >= 0.05 THEN 'positive' WHEN s <= -0.05 THEN 'inverted' ELSE 'flat' END AS d FROM gc),
ge AS (SELECT target_id, max(s) AS best, first(feature_group ORDER BY round(s, 12) DESC, n DESC, list_position(['technical', 'technical_fourier', 'technical_wavelet', 'all'], feature_group)) AS g,
  first(coalesce(spread, auc) ORDER BY round(s, 12) DESC, n DESC, list_position(['technical', 'technical_fourier', 'technical_wavelet', 'all'], feature_group)) AS m,
  CASE WHEN count(*) FILTER (d = 'positive') = count(*) THEN 'Consistent positive' WHEN count(*) FILTER (d = 'positive') > 0 AND count(*) FILTER (d = 'inverted') = 0 THEN 'Mostly positive' WHEN count(*) FILTER (d = 'positive') > 0 THEN 'Feature-group dependent'
    WHEN count(*) FILTER (d = 'inverted') > 0 THEN 'Inverted or unstable' ELSE 'Weak' END AS c FROM gd GROUP BY 1),
gr AS (SELECT target_id, count(*) FILTER (direction = 'positive') AS p, count(*) FILTER (direction = 'inverted') AS i, min(spread) AS w FROM reg GROUP BY 1),
gs AS (SELECT *, CASE WHEN i > 0 AND best >= 0.05 THEN 'Promising but regime-sensitive' WHEN c IN ('Feature-group dependent', 'Inverted or unstable') AND best >= 0.05 THEN 'Feature-group dependent'
  WHEN best >= 0.1 AND c IN ('Consistent positive', 'Mostly positive') THEN 'Strong candidate' WHEN best >= 0.05 OR p > 0 THEN 'Promising but regime-sensitive' ELSE 'Weak' END AS l FROM ge JOIN gr USING (target_id))""",
        f"""SELECT target_id, g AS best_feature_group, {r('m', 'best_feature_group_metric')}, c AS feature_group_consistency, p AS regime_positive_count, i AS regime_negative_count, {r('w', 'worst_regime_bucket_spread')}, l AS overall_stability,
  CASE l WHEN 'Strong candidate' THEN 'Yes' WHEN 'Weak' THEN 'No' ELSE 'Review' END AS next_step_candidate FROM gs""",
    ),
)
def target_stability(spark, sf):
    panel = _targets(spark, sf)
    groups = tg.group_comparison(_group_predictions(spark, sf, panel))
    targets = spark.createDataFrame([(t,) for t in TARGET_LABELS], "target_id string")
    return shown(tg.stability(targets, groups, tg.regime_table(_predictions(spark, sf, panel))))


def _model_predictions(spark, sf):
    """Out-of-sample predictions of the four feature groups' models for every target."""
    panel = stored(tr.waves(lb.target_candidates(fx.featured(spark, sf), "SPY")))
    return stored(md.group_predictions(panel, _groups(panel), TARGET_LABELS, keep=("regime",)))


@query("target_feature_group_models")
def target_feature_group_models(spark, sf):
    """``target_feature_groups`` over fitted models; that query is the checked twin over formulas."""
    out = tg.group_comparison(_model_predictions(spark, sf))
    return shown(out, "target_id", "feature_group", "prediction_count", "positive_rate", "roc_auc", "pr_auc", "bucket_spread")


@query("target_stability_models")
def target_stability_models(spark, sf):
    """``target_stability`` over fitted models; the regime rows are those of the technical group."""
    predictions = _model_predictions(spark, sf)
    targets = spark.createDataFrame([(t,) for t in TARGET_LABELS], "target_id string")
    regimes = tg.regime_table(predictions.filter("feature_group = 'technical'").drop("feature_group"))
    return shown(tg.stability(targets, tg.group_comparison(predictions), regimes))


@query("risk_feature_group_models")
def risk_feature_group_models(spark, sf):
    """``risk_feature_groups`` over the four groups' fitted models; that query is the checked twin over formulas."""
    panel = _full_panel(spark, sf)
    label, days = "label_drawdown_risk_20d", fx.shipping_days(spark, sf)
    scored = md.group_predictions(panel, _groups(panel), {"risk": label}, keep=("regime", "return_60d", "forward_20d_excess_return"))
    scored = scored.select(
        "feature_group", "fold", "date", "ticker", "regime", "actual", "probability", F.col("return_60d").alias("momentum"), F.col("forward_20d_excess_return").alias("forward_excess_return")
    )
    own = (panel.select("ticker", "date", F.col(label).alias("label"), "regime", F.col("return_60d").alias("momentum")))
    return shown(ch.risk_increment(stored(ch.fold_rates(scored, own, fo.walk_forward(days))), ["feature_group"]))


@query(
    "target_arena",
    sp.with_(
        PRED_SQL + QUALITY_PART + """,
ar AS (SELECT *, CASE target_id WHEN 'tail_adjusted_outperform_20d' THEN 'drawdown_adjusted_opportunity_20d' ELSE target_id END AS id FROM qual),
as_ AS (SELECT *, coalesce(spread > 0, false) AND coalesce(spread >= b_s - 0.005, true) AND coalesce(brier <= b_b + 0.02, true) AND coalesce(abs(gap) <= abs(b_g) + 0.03, true) AND inv <= b_i AS sound FROM ar
  WHERE id IN ('outperform_20d', 'top_tercile_excess_20d', 'risk_adjusted_excess_20d', 'drawdown_adjusted_opportunity_20d', 'pullback_recovery_20d')),
ae AS (SELECT *, CASE WHEN n < 50 OR q = 'Unusable' OR cb = 'Unusable' THEN 'insufficient' WHEN q = 'Weak' OR bq = 'Inverted' THEN 'weak' WHEN id = 'outperform_20d' THEN CASE WHEN q = 'Mixed' THEN 'mixed' ELSE 'promising' END
  WHEN q = 'Promising' AND sound AND cq IN ('Good', 'Acceptable') AND rs = 'Stable across regimes' THEN 'strong' WHEN sound AND cq <> 'Poor' THEN 'promising' ELSE 'mixed' END AS e FROM as_),
af AS (SELECT *, concat_ws('; ', CASE WHEN cb IN ('Skewed', 'Unusable') THEN 'class balance is ' || lower(cb) END, CASE WHEN cq = 'Poor' THEN 'calibration is poor' END, CASE WHEN bq IN ('Weak', 'Inverted') THEN 'bucket separation is ' || lower(bq) END,
  CASE rs WHEN 'Inverted in some regimes' THEN 'some regimes are inverted' WHEN 'Regime-sensitive' THEN 'evidence is regime-sensitive' END) AS why FROM ae)""",
        """SELECT id AS target_id, n AS sample_count, e AS evidence_classification, CASE WHEN id = 'outperform_20d' THEN 'current_baseline' WHEN e = 'strong' THEN 'best_candidate' WHEN e = 'promising' THEN 'future_research_candidate' ELSE 'reject_for_now' END AS arena_decision,
  CASE WHEN e IN ('strong', 'promising') THEN '' WHEN why <> '' THEN why ELSE 'evidence is not clearly better than the current production target' END AS rejection_reason, e IN ('strong', 'promising') AND id <> 'outperform_20d' AS future_production_experiment FROM af""",
    ),
)
def target_arena(spark, sf):
    return shown(tg.arena(settle(_quality(spark, sf))), "target_id", "sample_count", "evidence_classification", "arena_decision", "rejection_reason", "future_production_experiment")


@query("top_importance")
def top_importance(spark, sf):
    """Largest mean importances of walk-forward fits; the strengths depend on the solver."""
    [(_, strengths)] = _validated(spark, sf, "label_drawdown_risk_20d")
    return shown(md.top_importance(strengths))


# Evidence area -> the registered queries whose classes stand for it.
EVIDENCE = {
    "ML reliability by regime": ("reliability_by_regime",),
    "ML reliability gate": ("gates",),
    "Momentum quality": ("momentum_quality",),
    "Earnings / PEAD": ("pead_summary",),
    "Validation leakage / overfit": ("leakage", "fold_stability", "overfit_warnings"),
    "Portfolio crowding": ("crowding", "factor_crowding"),
    "Feature importance stability": ("importance_readiness",),
}


def _evidence_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT '{area}' AS area, classification FROM ({ORACLES[n]})" for area, names in EVIDENCE.items() for n in names)
    order = ", ".join(f"'{x}'" for x in fixed.EVIDENCE_PRIORITY)
    strength = " ".join("WHEN c IN ({}) THEN '{}'".format(", ".join(f"'{x}'" for x in labels), name) for name, labels in fixed.EVIDENCE_STRENGTH.items())
    areas = ", ".join(f"('{a}')" for a in EVIDENCE)
    return f"""WITH ev AS MATERIALIZED ({parts}), cnt AS (SELECT area, lower(classification) AS c, count(*) AS n FROM ev WHERE classification IS NOT NULL GROUP BY 1, 2),
pl AS (SELECT *, coalesce(list_position([{order}], c), 0) AS p FROM cnt),
best AS (SELECT area, first(c ORDER BY CASE WHEN p > 0 THEN p ELSE 999 END, CASE WHEN p > 0 THEN 0 ELSE -n END, c) AS c FROM pl GROUP BY 1),
st AS (SELECT v.area, coalesce(best.c, 'unavailable') AS c FROM (VALUES {areas}) v(area) LEFT JOIN best USING (area)),
sg AS (SELECT area, c, CASE {strength} ELSE 'watch' END AS s FROM st)
SELECT area, c AS latest_classification, s AS evidence_strength, CASE s WHEN 'useful' THEN 'research_only' WHEN 'unavailable' THEN 'unavailable' ELSE 'not_ready' END AS production_readiness FROM sg
UNION ALL SELECT 'Overall production readiness', 'not_ready', 'blocking', 'not_ready'"""


@query("evidence_rollup", _evidence_sql())
def evidence_rollup(spark, sf):
    """Worst class of each evidence area over the registered diagnostic tables."""
    parts = []  # one after the other: of each only the counts stay on disk
    for area, names in EVIDENCE.items():
        for name in names:
            with passing(spark):
                parts.append(settle(tg.class_counts(QUERIES[name](spark, sf).select(F.lit(area).alias("area"), "classification"))))
    return tg.evidence_of(reduce(DataFrame.unionByName, parts), list(EVIDENCE))
