"""Metrics and diagnostic tables over the score panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import metrics as mt
from tickerloom.operators import scorecards as sc
from tickerloom.plans.storage import settle, stored
from workload import fixtures as fx
from workload import sqlparts as sp
from workload.registry import query, r, rs, shown

BAND = "CASE WHEN {0} <= 40 THEN 'Low' WHEN {0} <= 70 THEN 'Medium' ELSE 'High' END"


def _scores(spark, sf, regimes=False):
    return stored(fx.scores(spark, sf, regimes))


def metrics_sql(name: str, source: str, by: str, y: str, p: str) -> str:
    """AUC by average ranks, average precision by distinct thresholds, over plain windows."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN {name}_t USING ({by})" if by else f", {name}_t"
    return f"""
{name}_k AS MATERIALIZED (SELECT {g}{y} AS y, {p} AS p FROM {source} WHERE {y} IS NOT NULL AND {p} IS NOT NULL),
{name}_r AS (SELECT *, rank() OVER ({part} ORDER BY p) + (count(*) OVER (PARTITION BY {g}p) - 1) / 2.0 AS rk FROM {name}_k),
{name}_t AS MATERIALIZED (SELECT {g}count(*) AS n, sum(y) AS pos, avg(y) AS rate, avg(p) AS mp, avg((p - y) * (p - y)) AS brier, sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS rsum,
  count(*) FILTER (p >= 0.5 AND y = 1) AS hit, count(*) FILTER (p >= 0.5) AS called FROM {name}_r {group}),
{name}_v AS (SELECT {g}p, sum(y) AS tp, count(*) AS c FROM {name}_k GROUP BY {g}p),
{name}_w AS (SELECT *, sum(tp) OVER ({part} ORDER BY p DESC) AS ct, sum(c) OVER ({part} ORDER BY p DESC) AS cc FROM {name}_v),
{name}_a AS (SELECT {g}sum(tp / pos * ct / cc) AS ap FROM {name}_w {join} {group}),
{name} AS MATERIALIZED (SELECT t.*, CASE WHEN pos > 0 AND pos < n THEN (rsum - pos * (pos + 1) / 2) / (pos * (n - pos)) END AS auc,
  CASE WHEN pos > 0 AND pos < n THEN ap END AS ap FROM {name}_t t {f"JOIN {name}_a USING ({by})" if by else f", {name}_a"})"""


METRIC_COLUMNS = "positive_rate, mean_probability, calibration_gap, brier_score, accuracy, precision, recall, f1, roc_auc, pr_auc"


def metric_select(by: str) -> str:
    g = f"{by}, " if by else ""
    prec, rec = "coalesce(hit / nullif(called, 0), 0)", "coalesce(hit / nullif(pos, 0), 0)"
    return (
        f"{g}n AS sample_count, {r('rate', 'positive_rate')}, {r('mp', 'mean_probability')}, {r('rate - mp', 'calibration_gap')}, {r('brier', 'brier_score')}, "
        f"{r('(hit + (n - pos) - (called - hit)) / n', 'accuracy')}, {r(prec, 'precision')}, {r(rec, 'recall')}, "
        f"{r(f'coalesce(2 * {prec} * {rec} / nullif({prec} + {rec}, 0), 0)', 'f1')}, {r('auc', 'roc_auc')}, {r('ap', 'pr_auc')}"
    )


@query("classification_metrics", sp.with_(sp.SCORES + "," + metrics_sql("m", "scores", "", "actual_out", "probability_out"), f"SELECT {metric_select('')} FROM m"))
def classification_metrics(spark, sf):
    return shown(mt.binary_metrics(_scores(spark, sf), [], "actual_out", "probability_out").drop("positive_count"))


@query("fold_metrics", sp.with_(sp.SCORES + "," + metrics_sql("m", "scores", "fold", "actual_risk", "probability_risk"), f"SELECT {metric_select('fold')} FROM m"))
def fold_metrics(spark, sf):
    return shown(mt.binary_metrics(_scores(spark, sf), ["fold"], "actual_risk", "probability_risk").drop("positive_count"))


@query("ticker_metrics", sp.with_(sp.SCORES + "," + metrics_sql("m", "scores", "ticker", "actual_out", "probability_out"), f"SELECT {metric_select('ticker')} FROM m"))
def ticker_metrics(spark, sf):
    return shown(mt.binary_metrics(_scores(spark, sf), ["ticker"], "actual_out", "probability_out", calendar_bound=True).drop("positive_count"))


@query(
    "confusion",
    sp.with_(
        sp.SCORES,
        "SELECT 'Actual ' || a AS actual, count(*) FILTER (NOT c AND y = a) AS predicted_0, count(*) FILTER (c AND y = a) AS predicted_1 FROM (SELECT unnest([0, 1]) AS a), "
        "(SELECT CAST(actual_out AS INT) AS y, probability_out >= 0.5 AS c FROM scores) GROUP BY a",
    ),
)
def confusion(spark, sf):
    return mt.confusion(fx.scores(spark, sf), "actual_out", "probability_out")


def calibration_sql(bins: int) -> str:
    cases = " ".join(f"WHEN probability_risk <= {i / bins!r} THEN {i - 1}" for i in range(1, bins + 1))
    return f"""
cal AS MATERIALIZED (SELECT CAST(CASE {cases} END AS BIGINT) AS bin, count(*) AS n, avg(probability_risk) AS mp, avg(actual_risk) AS rate FROM scores GROUP BY 1)"""


@query(
    "calibration",
    sp.with_(sp.SCORES + "," + calibration_sql(10), f"SELECT bin, n AS count, {r('mp', 'average_probability')}, {r('rate', 'observed_rate')}, {r('rate - mp', 'calibration_gap')} FROM cal"),
)
def calibration(spark, sf):
    return shown(mt.calibration(fx.scores(spark, sf), "actual_risk", "probability_risk"))


@query(
    "calibration_summary",
    sp.with_(
        sp.SCORES,
        f"SELECT fold, count(*) AS sample_size, {r('avg(probability_risk)', 'average_predicted_probability')}, {r('avg(actual_risk)', 'observed_positive_rate')}, "
        f"{r('avg(actual_risk) - avg(probability_risk)', 'calibration_gap')}, {r('avg((probability_risk - actual_risk) ^ 2)', 'brier_score')} FROM scores GROUP BY fold",
    ),
)
def calibration_summary(spark, sf):
    return shown(mt.calibration_summary(fx.scores(spark, sf), "actual_risk", "probability_risk", ["fold"]))


@query(
    "calibration_quality",
    sp.with_(
        sp.SCORES + "," + calibration_sql(5) + """,
q AS (SELECT sum(n) AS s, sum(mp * n) / sum(n) AS p, sum(rate * n) / sum(n) AS o, sum(abs(rate - mp) * n) / sum(n) AS mae, max(abs(rate - mp)) AS mx, count(*) AS k FROM cal),
d AS (SELECT coalesce(bool_and(df >= -1e-12), true) AS up FROM (SELECT rate - lag(rate) OVER (ORDER BY mp) AS df FROM cal) WHERE df IS NOT NULL),
b AS (SELECT avg((probability_risk - actual_risk) ^ 2) AS br FROM scores)""",
        f"""SELECT CAST(s AS BIGINT) AS sample_size, {r('p', 'mean_predicted_risk')}, {r('o', 'observed_drawdown_rate')}, {r('mae', 'mean_absolute_calibration_error')}, {r('mx', 'max_bucket_calibration_gap')},
  CASE WHEN k >= 2 AND up THEN 'higher buckets aligned' ELSE 'not clearly monotonic' END AS monotonicity, {r('o - p', 'calibration_gap')}, {r('br', 'brier_score')},
  CASE WHEN s < 20 THEN 'insufficient' WHEN NOT (k >= 2 AND up) THEN 'not monotonic' WHEN o - p > 0.1 THEN 'underestimates' WHEN o - p < -0.1 THEN 'overestimates'
    WHEN mae > 0.15 OR mx > 0.25 THEN 'weak' ELSE 'aligned' END AS interpretation FROM q, d, b""",
    ),
)
def calibration_quality(spark, sf):
    s = _scores(spark, sf)
    return shown(sc.calibration_quality(mt.calibration(s, "actual_risk", "probability_risk", 5), mt.calibration_summary(s, "actual_risk", "probability_risk")))


QUINT = "average_score, hit_rate, average_forward_return, average_forward_excess_return, average_forward_drawdown"


@query(
    "quintiles",
    sp.with_(
        sp.SCORES + ", e AS (SELECT " + ", ".join(f"quantile_cont(probability_out, {i / 5}) AS q{i}" for i in range(1, 5)) + " FROM scores)",
        f"""SELECT 'Q' || (1 + (p > q1)::INT + (p > q2)::INT + (p > q3)::INT + (p > q4)::INT) AS score_quintile, count(*) AS count, {r('avg(p)', 'average_score')}, {r('avg(actual_out)', 'hit_rate')},
  {r('avg(forward_return)', 'average_forward_return')}, {r('avg(forward_excess_return)', 'average_forward_excess_return')}, {r('avg(forward_drawdown)', 'average_forward_drawdown')}
  FROM (SELECT *, probability_out AS p FROM scores), e GROUP BY 1""",
    ),
)
def quintiles(spark, sf):
    return shown(mt.quintiles(_scores(spark, sf), "probability_out", "actual_out"))


BUCKET_COLUMNS = {
    "average_ml_score": "ml_score", "outperformance_hit_rate": "actual_out", "average_outperformance_probability": "probability_out",
    "average_drawdown_risk_probability": "probability_risk", "drawdown_risk_rate": "actual_risk", "average_forward_return": "forward_return",
    "average_forward_excess_return": "forward_excess_return", "average_forward_drawdown": "forward_drawdown",
}


@query(
    "score_buckets",
    sp.with_(sp.SCORES, f"SELECT {BAND.format('ml_score')} AS score_bucket, count(*) AS count, {', '.join(r(f'avg({c})', n) for n, c in BUCKET_COLUMNS.items())} FROM scores GROUP BY 1"),
)
def score_buckets(spark, sf):
    return shown(sc.score_buckets(fx.scores(spark, sf)))


def bands_sql(score: str, value: str, prefix: str, minimum: int = 5) -> str:
    out = []
    for b, cond in (("low", f"{score} <= 40"), ("medium", f"{score} > 40 AND {score} <= 70"), ("high", f"{score} > 70")):
        out.append(f"CASE WHEN count({value}) FILTER ({cond}) >= {minimum} THEN avg({value}) FILTER ({cond}) END AS {prefix}_{b}")
    return ", ".join(out)


DIRECTION = "CASE WHEN {n} < 20 OR {s} IS NULL THEN 'insufficient' WHEN {s} > 0.0025 THEN 'aligned' WHEN {s} < -0.0025 THEN 'inverted' ELSE 'flat' END"


def shape_sql(lo: str, mid: str, hi: str) -> str:
    a, b = f"({mid} - {lo})", f"({hi} - {mid})"
    return (
        f"CASE WHEN {lo} IS NULL OR {mid} IS NULL OR {hi} IS NULL THEN 'insufficient' WHEN {a} > 0.0025 AND {b} > 0.0025 THEN 'aligned' "
        f"WHEN {a} < -0.0025 AND {b} < -0.0025 THEN 'inverted' WHEN abs{a} <= 0.0025 AND abs{b} <= 0.0025 THEN 'flat' ELSE 'mixed' END"
    )


@query(
    "score_direction",
    sp.with_(
        sp.SCORES + f""",
rk AS (SELECT *, rank() OVER (ORDER BY ml_score) + (count(*) OVER (PARTITION BY ml_score) - 1) / 2.0 AS a, rank() OVER (ORDER BY forward_excess_return) + (count(*) OVER (PARTITION BY forward_excess_return) - 1) / 2.0 AS b FROM scores),
z AS (SELECT count(*) AS n, corr(a, b) AS c1, corr(a, actual_out) AS c2, corr(a, actual_risk) AS c3, {bands_sql('ml_score', 'forward_excess_return', 'm')} FROM rk)""",
        f"""SELECT n AS sample_size, {r('c1', 'score_to_forward_return_spearman')}, {r('c2', 'score_to_return_label_spearman')}, {r('c3', 'score_to_drawdown_label_spearman')},
  {r('m_high', 'top_bucket_forward_return')}, {r('m_low', 'bottom_bucket_forward_return')}, {r('m_high - m_low', 'top_minus_bottom_spread')}, {DIRECTION.format(n='n', s='(m_high - m_low)')} AS direction FROM z""",
    ),
)
def score_direction(spark, sf):
    return shown(sc.direction_summary(_scores(spark, sf)))


@query(
    "regime_score_direction",
    sp.with_(
        sp.REGIME_SCORES + f""", du AS (SELECT 'regime' AS d, regime AS v, ml_score, forward_excess_return FROM scores UNION ALL SELECT 'trend', split_part(regime, ' / ', 1), ml_score, forward_excess_return FROM scores),
dz AS (SELECT d, v, count(*) AS n, {bands_sql('ml_score', 'forward_excess_return', 'm')} FROM du WHERE v IS NOT NULL GROUP BY 1, 2)""",
        f"""SELECT d AS regime_dimension, v AS regime, n AS sample_size, {r('m_high', 'top_bucket_forward_return')}, {r('m_low', 'bottom_bucket_forward_return')}, {r('m_high - m_low', 'top_minus_bottom_spread')},
  {DIRECTION.format(n='n', s='(m_high - m_low)')} AS direction FROM dz""",
    ),
)
def regime_score_direction(spark, sf):
    """Two regime columns: the regime and its trend part."""
    s = stored(fx.scores(spark, sf, True)).withColumn("trend", F.split_part("regime", F.lit(" / "), F.lit(1)))
    return shown(sc.regime_direction(s, ("regime", "trend")))


@query(
    "baseline_comparison",
    sp.with_(
        sp.SCORES + f""",
e AS (SELECT quantile_cont(return_60d, 1 / 3) AS q1, quantile_cont(return_60d, 2 / 3) AS q2 FROM scores WHERE return_60d IS NOT NULL),
b AS (SELECT 'ML score' AS signal, count(*) AS n, avg(forward_excess_return) FILTER (ml_score > 70) AS t, avg(forward_excess_return) FILTER (ml_score <= 40) AS l FROM scores
  UNION ALL SELECT 'No-skill / universe average', count(*), avg(forward_excess_return), avg(forward_excess_return) FROM scores
  UNION ALL SELECT '60d momentum', count(*), avg(forward_excess_return) FILTER (return_60d > q2), avg(forward_excess_return) FILTER (return_60d <= q1) FROM scores, e WHERE return_60d IS NOT NULL),
c AS (SELECT *, t - l AS s, max(CASE WHEN signal = 'ML score' THEN t - l END) OVER () AS ml, max(CASE WHEN signal <> 'ML score' THEN t - l END) OVER () AS best FROM b),
d AS (SELECT *, CASE WHEN signal = 'ML score' THEN best ELSE ml END AS o FROM c)""",
        f"""SELECT signal, n AS sample_size, {r('t', 'top_bucket_forward_return')}, {r('l', 'bottom_bucket_forward_return')}, {r('s', 'spread')},
  CASE WHEN s > 0 THEN 'top bucket higher' WHEN s < 0 THEN 'bottom bucket higher' ELSE 'flat' END AS direction,
  CASE WHEN signal LIKE 'No-skill%' THEN 'reference' WHEN s > o + 0.0025 THEN 'better' WHEN s + 0.0025 < o THEN 'worse' ELSE 'similar' END AS relative_read FROM d""",
    ),
)
def baseline_comparison(spark, sf):
    return shown(sc.baseline_comparison(_scores(spark, sf), "return_60d", "60d momentum"))


@query(
    "score_alignment",
    sp.with_(
        sp.SCORES + ", u AS (" + " UNION ALL ".join(
            f"SELECT '{d}' AS diagnostic, '{up}' AS up, '{down}' AS down, ml_score, {'CAST(forward_drawdown <= -0.10 AS DOUBLE)' if c == 'drawdown_event' else c} AS v FROM scores" for d, c, up, down in sc.ALIGNMENTS
        ) + f"), z AS (SELECT diagnostic, up, down, count(v) AS n, {bands_sql('ml_score', 'v', 'm')} FROM u GROUP BY 1, 2, 3)",
        f"""SELECT diagnostic, n AS sample_size, {r('m_low', 'bottom_score_bucket_mean')}, {r('m_high', 'top_score_bucket_mean')}, {r('m_high - m_low', 'top_minus_bottom_spread')},
  CASE WHEN m_high - m_low IS NULL THEN 'insufficient' WHEN m_high - m_low > 0.0025 THEN up WHEN m_high - m_low < -0.0025 THEN down ELSE 'similar values' END AS higher_score_corresponds_to FROM z""",
    ),
)
def score_alignment(spark, sf):
    return shown(sc.alignment(fx.scores(spark, sf)))


@query(
    "bucket_monotonicity",
    sp.with_(
        sp.SCORES + f", z AS (SELECT {bands_sql('ml_score', 'forward_excess_return', 'm', 1)} FROM scores)",
        f"""SELECT bucket, count(*) AS sample_size, {r('avg(ml_score)', 'mean_score')}, {r('avg(forward_excess_return)', 'mean_forward_return')}, {r('avg(actual_out)', 'return_label_rate')},
  {r('avg(actual_risk)', 'drawdown_label_rate')}, any_value({shape_sql('m_low', 'm_medium', 'm_high')}) AS monotonicity_result FROM (SELECT *, {BAND.format('ml_score')} AS bucket FROM scores), z GROUP BY 1""",
    ),
)
def bucket_monotonicity(spark, sf):
    return shown(sc.bucket_monotonicity(_scores(spark, sf)))


@query(
    "score_inversion",
    sp.with_(
        sp.SCORES + f""", mx AS (SELECT max(ml_score) AS m FROM scores),
u AS (SELECT 'original' AS d, ml_score AS s, forward_excess_return AS f FROM scores UNION ALL SELECT 'inverted', m - ml_score, forward_excess_return FROM scores, mx),
z AS (SELECT d, count(*) AS n, {bands_sql('s', 'f', 'm')} FROM u GROUP BY 1),
y AS (SELECT *, m_high - m_low AS sp, max(CASE WHEN d = 'original' THEN m_high - m_low END) OVER () AS o, max(CASE WHEN d = 'inverted' THEN m_high - m_low END) OVER () AS i FROM z)""",
        f"""SELECT d AS score_direction, n AS sample_size, {r('m_high', 'top_bucket_forward_return')}, {r('m_low', 'bottom_bucket_forward_return')}, {r('sp', 'top_minus_bottom_spread')},
  CASE WHEN o > i + 0.0025 THEN 'original' WHEN i > o + 0.0025 THEN 'inverted' ELSE 'similar' END AS better_forward_return_separation FROM y""",
    ),
)
def score_inversion(spark, sf):
    return shown(sc.inversion(_scores(spark, sf)))


def rank_bucket_sql(k: int, order: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    pos = f"row_number() OVER ({p}ORDER BY {order}, date, ticker)"
    n = f"count(*) OVER ({p.strip()})"
    return f"greatest(ceil(({pos} - 1) * {k} / nullif({n} - 1, 0)) - 1, 0)"


def thirds_sql(signals: dict[str, str]) -> str:
    union = " UNION ALL ".join(f"SELECT '{n}' AS signal, {e} AS s, date, ticker, forward_excess_return AS f, actual_out AS y, actual_risk AS k FROM scores" for n, e in signals.items())
    cols = ", ".join(
        f"avg(f) FILTER (b = {i}) AS f{i}, avg(y) FILTER (b = {i}) AS y{i}, avg(k) FILTER (b = {i}) AS k{i}" for i in range(3)
    )
    return f""", u AS ({union}), v AS (SELECT *, {rank_bucket_sql(3, 's', 'signal')} AS b FROM u), z AS (SELECT signal, count(*) AS n, {cols} FROM v GROUP BY 1)"""


@query(
    "probability_direction",
    sp.with_(
        sp.SCORES + thirds_sql({"raw probability": "probability_out", "inverted probability": "1 - probability_out", "current ML Score": "ml_score"}),
        f"""SELECT signal, n AS sample_size, {r('f0', 'low_bucket_forward_excess_return')}, {r('f1', 'mid_bucket_forward_excess_return')}, {r('f2', 'high_bucket_forward_excess_return')},
  {r('f2 - f0', 'high_minus_low_spread')}, {shape_sql('f0', 'f1', 'f2')} AS monotonicity, {r('y0', 'actual_label_rate_low_bucket')}, {r('y2', 'actual_label_rate_high_bucket')} FROM z""",
    ),
)
def probability_direction(spark, sf):
    return shown(sc.probability_direction(_scores(spark, sf)))


_HC = "100 * sqrt(probability_out) * CASE WHEN probability_risk >= 0.6 THEN 0.7 WHEN probability_risk >= 0.4 THEN 0.85 ELSE 1.0 END"


@query(
    "formula_candidates",
    sp.with_(
        sp.SCORES + thirds_sql({
            "raw_probability": "100 * probability_out", "sqrt_opportunity_only": "100 * sqrt(probability_out)", "current_production_score": "100 * probability_out",
            "light_risk_penalty": "100 * (0.85 * sqrt(probability_out) + 0.15 * (1 - probability_risk))", "risk_haircut_score": _HC,
        }),
        f"""SELECT signal AS candidate_name, n AS sample_size, {r('f0', 'low_bucket_forward_excess_return')}, {r('f1', 'mid_bucket_forward_excess_return')}, {r('f2', 'high_bucket_forward_excess_return')},
  {r('f2 - f0', 'high_minus_low_spread')}, {shape_sql('f0', 'f1', 'f2')} AS monotonicity, {r('y0', 'low_bucket_label_rate')}, {r('y2', 'high_bucket_label_rate')},
  {r('k0', 'low_bucket_drawdown_event_rate')}, {r('k2', 'high_bucket_drawdown_event_rate')},
  CASE WHEN f2 - f0 < -0.0025 OR {shape_sql('f0', 'f1', 'f2')} = 'inverted' THEN 'candidate is inverted'
    WHEN f2 - f0 > 0.0025 AND {shape_sql('f0', 'f1', 'f2')} = 'aligned' AND y2 > y0 + 0.0025 AND k2 <= k0 + 0.2 THEN 'candidate looks strong'
    WHEN f2 - f0 <= 0.0025 OR NOT y2 > y0 + 0.0025 THEN 'candidate looks weak' ELSE 'candidate is mixed' END AS interpretation FROM z""",
    ),
)
def formula_candidates(spark, sf):
    return shown(sc.formula_candidates(_scores(spark, sf)))


@query(
    "joint_2x2",
    sp.with_(
        sp.SCORES + f""",
v AS (SELECT *, {rank_bucket_sql(2, 'probability_out')} AS o, {rank_bucket_sql(2, 'probability_risk')} AS k FROM scores),
z AS (SELECT CASE o WHEN 0 THEN 'Low' ELSE 'High' END || ' opportunity' AS opportunity_bucket, CASE k WHEN 0 THEN 'Low' ELSE 'High' END || ' risk' AS risk_bucket,
  count(*) AS n, avg(forward_excess_return) AS f, avg(forward_drawdown) AS d, avg(actual_risk) AS e FROM v GROUP BY 1, 2),
c AS (SELECT max(CASE WHEN opportunity_bucket LIKE 'High%' AND risk_bucket LIKE 'Low%' THEN f END) - max(CASE WHEN opportunity_bucket LIKE 'Low%' AND risk_bucket LIKE 'High%' THEN f END) > 0.0025 AS a,
  max(CASE WHEN opportunity_bucket LIKE 'High%' AND risk_bucket LIKE 'High%' THEN d END) < max(CASE WHEN opportunity_bucket LIKE 'High%' AND risk_bucket LIKE 'Low%' THEN d END) - 0.0025
  OR max(CASE WHEN opportunity_bucket LIKE 'High%' AND risk_bucket LIKE 'High%' THEN e END) - max(CASE WHEN opportunity_bucket LIKE 'High%' AND risk_bucket LIKE 'Low%' THEN e END) > 0.0025 AS b FROM z)""",
        f"""SELECT opportunity_bucket, risk_bucket, n AS sample_size, {r('f', 'avg_forward_excess_return')}, {r('d', 'avg_forward_drawdown')}, {r('e', 'drawdown_event_rate')},
  CASE WHEN a AND b THEN 'joint validation supports separate opportunity and risk signals' WHEN NOT a AND NOT b THEN 'joint validation does not support the combined signal'
    ELSE 'joint validation is mixed' END AS joint_validation_result FROM z, c""",
    ),
)
def joint_2x2(spark, sf):
    return shown(sc.joint_grid(_scores(spark, sf)))


def _versions(spark, sf):
    s = fx.scores(spark, sf)
    entries = [
        F.struct(F.lit("v1").alias("target_version"), F.col("probability_out").alias("probability"), F.col("forward_excess_return").alias("target")),
        F.struct(F.lit("v2").alias("target_version"), (F.col("probability_out") - 0.5 * F.col("probability_risk")).alias("probability"), F.col("forward_risk_adjusted").alias("target")),
        F.struct(F.lit("v3").alias("target_version"), (1 - F.col("probability_risk")).alias("probability"), F.col("forward_tail_adjusted").alias("target")),
    ]
    return stored(s.select("date", "ticker", F.inline(F.array(*entries))))


@query(
    "target_versions",
    sp.with_(
        sp.SCORES + f""",
u AS (SELECT 'v1' AS v, probability_out AS s, forward_excess_return AS t, date, ticker FROM scores UNION ALL SELECT 'v2', probability_out - 0.5 * probability_risk, forward_risk_adjusted, date, ticker FROM scores
  UNION ALL SELECT 'v3', 1 - probability_risk, forward_tail_adjusted, date, ticker FROM scores),
b AS (SELECT *, {rank_bucket_sql(3, 's', 'v')} AS b FROM u),
z AS (SELECT v, count(*) AS n, avg(t) FILTER (b = 0) AS f0, avg(t) FILTER (b = 1) AS f1, avg(t) FILTER (b = 2) AS f2 FROM b GROUP BY 1),
y AS (SELECT *, f2 - f0 AS sp, {shape_sql('f0', 'f1', 'f2')} AS mono FROM z),
x AS (SELECT *, CASE mono WHEN 'aligned' THEN 3 WHEN 'inverted' THEN 1 WHEN 'insufficient' THEN 0 ELSE 2 END AS o FROM y),
w AS (SELECT x.*, q.sp AS s1, q.o AS o1 FROM x, (SELECT * FROM x WHERE v = 'v1') q)""",
        f"""SELECT v AS target_version, n AS sample_size, {r('f0', 'low_bucket_target')}, {r('f1', 'middle_bucket_target')}, {r('f2', 'high_bucket_target')}, {r('sp', 'high_minus_low_spread')}, mono AS monotonicity,
  {r('s1', 'baseline_spread')}, CASE WHEN v = 'v1' THEN 'reference' WHEN (sp > s1 + 0.0025 AND o >= o1) OR (sp + 0.0025 >= s1 AND o > o1) THEN v || ' looks better'
  WHEN sp + 0.0025 < s1 OR o < o1 THEN v || ' looks worse' ELSE v || ' looks similar' END AS relative_result FROM w""",
    ),
)
def target_versions(spark, sf):
    return shown(sc.target_versions(_versions(spark, sf)))


SEG = "middle_bucket_forward_return, top_bucket_forward_return, bottom_bucket_forward_return, spread"


@query(
    "regime_segments",
    sp.with_(
        sp.REGIME_SCORES + f""",
u AS (SELECT 'regime' AS dim, regime AS g, ml_score, forward_excess_return FROM scores UNION ALL SELECT 'trend', CASE WHEN dist_ma_200d >= 0 THEN 'above 200d' WHEN dist_ma_200d < 0 THEN 'below 200d' END, ml_score, forward_excess_return FROM scores),
z AS (SELECT dim, g, count(*) AS n, count(*) FILTER (ml_score > 70) AS hi, count(*) FILTER (ml_score <= 40) AS lo, {bands_sql('ml_score', 'forward_excess_return', 'm')} FROM u WHERE g IS NOT NULL GROUP BY 1, 2),
y AS (SELECT *, m_high - m_low AS s FROM z)""",
        f"""SELECT dim AS regime_dimension, g AS regime, n AS sample_size, hi AS top_bucket_sample_size, lo AS bottom_bucket_sample_size, {r('m_medium', 'middle_bucket_forward_return')}, {r('m_high', 'top_bucket_forward_return')},
  {r('m_low', 'bottom_bucket_forward_return')}, {r('s', 'spread')}, {DIRECTION.format(n='n', s='s')} AS direction,
  CASE WHEN n < 20 OR s IS NULL THEN 'insufficient' WHEN s > 0.0025 THEN 'usable' WHEN s < -0.0025 THEN 'inverted' ELSE 'mixed' END AS evidence_quality FROM y""",
    ),
)
def regime_segments(spark, sf):
    s = fx.scores(spark, sf, True)
    s = s.withColumn("trend", F.when(F.col("dist_ma_200d") >= 0, "above 200d").when(F.col("dist_ma_200d") < 0, "below 200d"))
    return shown(sc.regime_segments(s, ["regime", "trend"]))


RELIABILITY_SQL = sp.REGIME_SCORES + "," + metrics_sql("m", "scores", "regime", "actual_out", "probability_out") + f""",
rl_o AS (SELECT regime, {bands_sql('ml_score', 'forward_excess_return', 'r')}, {bands_sql('ml_score', 'actual_risk', 'd')}, avg((probability_risk - actual_risk) ^ 2) AS db, avg(actual_risk - probability_risk) AS dg FROM scores GROUP BY 1),
rl_s AS (SELECT *, CASE WHEN r_low IS NOT NULL AND r_medium IS NOT NULL AND r_high IS NOT NULL THEN r_high - r_low END AS s, {shape_sql('r_low', 'r_medium', 'r_high')} AS mono,
  CASE WHEN d_low IS NOT NULL AND d_medium IS NOT NULL AND d_high IS NOT NULL THEN d_high - d_low END AS ds FROM rl_o JOIN m USING (regime)),
rl_f AS (SELECT *, n < 20 OR pos < 5 OR n - pos < 5 OR s IS NULL AS thin FROM rl_s),
rl_g AS (SELECT *, NOT thin AND (s < -0.0025 OR mono = 'inverted') AS inv,
  auc IS NULL OR auc < 0.52 OR ap < rate + 0.02 OR mono NOT IN ('aligned', 'flat') OR s <= 0.0025 AS wr, db > 0.25 OR abs(dg) > 0.15 AS wd, coalesce(ds > 0.0025, false) AND s <= 0.0025 AS cf FROM rl_f),
rel AS MATERIALIZED (SELECT regime, n AS sample_count, rate AS positive_rate, auc AS roc_auc, ap AS pr_auc, brier, s AS bucket_spread, mono AS score_bucket_monotonicity, db AS drawdown_brier, dg AS drawdown_calibration_gap,
  ds AS drawdown_bucket_spread, coalesce(inv, false) AS inversion_flag, thin AS insufficient_sample_flag,
  CASE WHEN thin THEN 'insufficient_sample' WHEN inv THEN 'inverted' WHEN wr AND cf THEN 'unstable' WHEN NOT wr AND NOT wd THEN 'reliable' ELSE 'mixed' END AS classification FROM rl_g)"""


@query(
    "reliability_by_regime",
    sp.with_(
        RELIABILITY_SQL,
        f"""SELECT regime, sample_count, {rs('positive_rate, roc_auc, pr_auc, brier, bucket_spread')}, score_bucket_monotonicity, {rs('drawdown_brier, drawdown_calibration_gap, drawdown_bucket_spread')},
  inversion_flag, insufficient_sample_flag, classification FROM rel""",
    ),
)
def reliability_by_regime(spark, sf):
    return shown(sc.reliability_by_regime(_scores(spark, sf, True)))


AUDIT = (
    "high_score_bucket_outcome_rate, low_score_bucket_outcome_rate, high_score_avg_forward_excess_return, low_score_avg_forward_excess_return, "
    "opportunity_bucket_spread, high_score_drawdown_rate, low_score_drawdown_rate, drawdown_reversal_bucket_spread"
)


@query(
    "bucket_audit",
    sp.with_(
        sp.REGIME_SCORES + """,
a AS (SELECT regime, count(*) AS sample_count, count(DISTINCT ticker) AS ticker_count, count(DISTINCT fold) AS fold_count, count(*) FILTER (ml_score > 70) AS high_score_sample_count, count(*) FILTER (ml_score <= 40) AS low_score_sample_count,
  avg(actual_out) FILTER (ml_score > 70) AS high_score_bucket_outcome_rate, avg(actual_out) FILTER (ml_score <= 40) AS low_score_bucket_outcome_rate,
  avg(forward_excess_return) FILTER (ml_score > 70) AS high_score_avg_forward_excess_return, avg(forward_excess_return) FILTER (ml_score <= 40) AS low_score_avg_forward_excess_return,
  avg(actual_risk) FILTER (ml_score > 70) AS high_score_drawdown_rate, avg(actual_risk) FILTER (ml_score <= 40) AS low_score_drawdown_rate FROM scores GROUP BY 1),
w AS (SELECT regime, arg_min(ticker, (round(m, 12), ticker)) AS worst_ticker FROM (SELECT regime, ticker, avg(forward_excess_return) AS m FROM scores WHERE ml_score > 70 GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT *, high_score_bucket_outcome_rate - low_score_bucket_outcome_rate AS opportunity_bucket_spread, high_score_drawdown_rate - low_score_drawdown_rate AS drawdown_reversal_bucket_spread FROM a LEFT JOIN w USING (regime)),
c AS (SELECT *, coalesce(opportunity_bucket_spread < -0.0025, false) OR coalesce(high_score_avg_forward_excess_return < low_score_avg_forward_excess_return - 0.0025, false) AS inv,
  coalesce(drawdown_reversal_bucket_spread > 0.0025, false) AS rk, sample_count < 20 OR high_score_sample_count < 5 OR low_score_sample_count < 5 AS thin FROM b),
d AS (SELECT *, CASE WHEN thin THEN 'insufficient_evidence' WHEN inv AND rk THEN 'overextension_risk' WHEN inv THEN 'worse_opportunity_outcome' WHEN opportunity_bucket_spread > 0.0025 AND NOT rk THEN 'better_opportunity_outcome'
  WHEN rk THEN 'higher_drawdown_reversal_risk' ELSE 'mixed' END AS classification FROM c)""",
        f"""SELECT regime, sample_count, ticker_count, fold_count, high_score_sample_count, low_score_sample_count, {rs(AUDIT)}, inv AS inversion_flag, inv AND rk AS overextension_risk_flag, worst_ticker, classification,
  CASE classification WHEN 'insufficient_evidence' THEN 'Needs more data' WHEN 'better_opportunity_outcome' THEN 'Continue' WHEN 'mixed' THEN 'Hold as audit-only' ELSE 'Pivot' END AS recommended_decision FROM d""",
    ),
)
def bucket_audit(spark, sf):
    return shown(sc.bucket_audit(fx.scores(spark, sf, True)))


_SOUND = "coalesce(classification NOT IN ('inverted', 'insufficient_sample'), false)"
_MASKS = ("true", "coalesce(classification <> 'inverted', false)", _SOUND, "coalesce(bucket_spread > 0.0025, false)", "probability_risk < 0.7",
          f"{_SOUND} AND coalesce(bucket_spread > 0.0025, false) AND probability_risk < 0.7")


def _side(flag: str, p: str) -> str:
    return f"""count(*) FILTER ({flag}) AS {p}_count, avg(actual_out) FILTER ({flag}) AS {p}_positive_rate, avg(forward_excess_return) FILTER ({flag}) AS {p}_avg_forward_excess_return,
  avg(actual_risk) FILTER ({flag}) AS {p}_drawdown_rate, CASE WHEN count(*) FILTER ({flag} AND ml_score > 70) >= 5 AND count(*) FILTER ({flag} AND ml_score <= 40) >= 5 THEN
  avg(forward_excess_return) FILTER ({flag} AND ml_score > 70) - avg(forward_excess_return) FILTER ({flag} AND ml_score <= 40) END AS {p}_bucket_spread, avg((probability_out - actual_out) ^ 2) FILTER ({flag}) AS {p}_brier"""


GATES_SQL = RELIABILITY_SQL + ", gt_u AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{g}' AS gate_name, {m} AS pass, s.* FROM scores s LEFT JOIN (SELECT regime AS rg, classification, bucket_spread FROM rel) ON rg = s.regime" for g, m in zip(sc.GATES, _MASKS)
) + f"""),
gt_a AS (SELECT gate_name, count(*) AS sample_count, {_side('pass', 'pass')}, {_side('NOT pass', 'fail')} FROM gt_u GROUP BY 1),
gt_b AS (SELECT a.*, pass_count / sample_count AS retention_rate, r0, p0, d0, gate_name = 'no_gate_baseline' AS base FROM gt_a a, (SELECT pass_avg_forward_excess_return AS r0, pass_positive_rate AS p0, pass_drawdown_rate AS d0 FROM gt_a WHERE gate_name = 'no_gate_baseline')),
gt_c AS (SELECT *, CASE WHEN base THEN pass_count < 20 ELSE pass_count < 20 OR fail_count < 20 END AS thin, retention_rate < 0.15 OR pass_count < 40 AS few,
  coalesce(pass_avg_forward_excess_return > r0 + 0.0025, false) OR coalesce(pass_positive_rate > p0 + 0.0025, false) AS better,
  coalesce(pass_avg_forward_excess_return < r0 - 0.0025, false) OR coalesce(pass_drawdown_rate > d0 + 0.05, false) OR coalesce(pass_bucket_spread < -0.0025, false) AS harm FROM gt_b),
gates AS MATERIALIZED (SELECT *, NOT thin AND NOT base AND better AS improvement_flag, NOT thin AND NOT base AND few AS overfit_warning_flag, thin AS insufficient_sample_flag,
  CASE WHEN thin THEN 'insufficient_sample' WHEN base THEN 'mixed' WHEN harm THEN 'harmful' WHEN better AND few THEN 'unstable' WHEN better THEN 'useful' ELSE 'mixed' END AS classification FROM gt_c)"""
GATE_NUM = ", ".join(f"{p}_{c}" for p in ("pass", "fail") for c in ("positive_rate", "avg_forward_excess_return", "drawdown_rate", "bucket_spread", "brier"))


@query(
    "gates",
    sp.with_(GATES_SQL, f"SELECT gate_name, sample_count, pass_count, fail_count, {rs(GATE_NUM)}, {rs('retention_rate')}, improvement_flag, overfit_warning_flag, insufficient_sample_flag, classification FROM gates"),
)
def gates(spark, sf):
    s = _scores(spark, sf, True)
    return shown(sc.gate_metrics(sc.gated(s, settle(sc.reliability_by_regime(s)))))


@query(
    "gates_by_regime",
    sp.with_(
        GATES_SQL,
        f"""SELECT gate_name, regime, sample_count, pass_count, {r('p', 'pass_positive_rate')}, {r('f', 'pass_avg_forward_excess_return')}, {r('d', 'pass_drawdown_rate')}, {r('pass_count / sample_count', 'retention_rate')},
  CASE WHEN pass_count < 20 THEN 'insufficient_sample' ELSE classification END AS classification FROM (
  SELECT gate_name, regime, count(*) AS sample_count, count(*) FILTER (pass) AS pass_count, avg(actual_out) FILTER (pass) AS p, avg(forward_excess_return) FILTER (pass) AS f, avg(actual_risk) FILTER (pass) AS d
  FROM gt_u GROUP BY 1, 2) JOIN (SELECT gate_name, classification FROM gates) USING (gate_name)""",
    ),
)
def gates_by_regime(spark, sf):
    s = _scores(spark, sf, True)
    rows = sc.gated(s, settle(sc.reliability_by_regime(s)))
    return shown(sc.gate_by_regime(rows, sc.gate_metrics(rows)))


@query(
    "drawdown_by_regime",
    sp.with_(
        sp.REGIME_SCORES + "," + metrics_sql("m", "scores", "regime", "actual_risk", "probability_risk") + f""",
a AS (SELECT regime, count(DISTINCT ticker) AS tc, count(DISTINCT fold) AS fc, {", ".join(f"avg(actual_risk) FILTER (b = '{b}') AS e_{b}, count(*) FILTER (b = '{b}') AS n_{b}" for b in ("low", "mid", "high"))}
  FROM (SELECT *, CASE WHEN probability_risk <= 1 / 3 THEN 'low' WHEN probability_risk <= 2 / 3 THEN 'mid' ELSE 'high' END AS b FROM scores) GROUP BY 1),
w AS (SELECT regime, arg_min(ticker, (-round(br, 12), ticker)) AS worst_ticker FROM (SELECT regime, ticker, avg((probability_risk - actual_risk) ^ 2) AS br FROM scores GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1),
z AS (SELECT *, e_high - e_low AS s, {shape_sql('e_low', 'e_mid', 'e_high')} AS mono FROM m JOIN a USING (regime) LEFT JOIN w USING (regime))""",
        f"""SELECT regime, n AS sample_count, tc AS ticker_count, fc AS fold_count, {r('rate', 'event_prevalence')}, {r('mp', 'mean_predicted_risk')}, {r('rate - mp', 'calibration_gap')}, {r('brier', 'brier_score')}, {r('ap', 'pr_auc')},
  {r('e_low', 'low_bucket_event_rate')}, {r('e_mid', 'mid_bucket_event_rate')}, {r('e_high', 'high_bucket_event_rate')}, {r('s', 'bucket_spread')}, mono AS monotonicity, worst_ticker,
  CASE WHEN n < 20 OR pos < 5 OR n - pos < 5 OR n_low < 5 OR n_high < 5 OR ap IS NULL OR s IS NULL THEN 'insufficient_evidence' WHEN mono = 'inverted' OR s < -0.0025 THEN 'inverted'
    WHEN mono = 'aligned' AND s > 0.0025 AND ap > rate + 0.02 AND abs(rate - mp) <= 0.15 AND brier <= 0.25 THEN 'usable_risk_signal' ELSE 'miscalibrated' END AS classification FROM z""",
    ),
)
def drawdown_by_regime(spark, sf):
    return shown(sc.drawdown_by_regime(_scores(spark, sf, True)))
