"""Label, feature, importance and validation audits, and baseline challenges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom import fixed
from tickerloom.operators import audits as au
from tickerloom.operators import challenge as ch
from tickerloom.operators import folds as fo
from tickerloom.operators import labels as lb
from tickerloom.operators import metrics as mt
from tickerloom.functions.stats import correlation
from tickerloom.plans.storage import passing, released, settle, stored
from workload import fixtures as fx
from workload import sqlparts as sp
from workload.q_features import ADVERSE_SQL, TARGET_SQL
from workload.q_scores import metrics_sql
from workload.registry import query, r, rs, shown

LABELS = ("label_outperform_20d", "label_drawdown_risk_20d")
BALANCE = "CASE WHEN n < 20 OR rate IS NULL THEN 'insufficient' WHEN rate <= 0 OR rate >= 1 THEN 'single class' WHEN rate < 0.1 THEN 'sparse positive' WHEN rate > 0.9 THEN 'highly common positive' ELSE 'balanced' END"
_LU = " UNION ALL ".join(f"SELECT '{c}' AS label, {c} AS v, ticker, regime FROM panel" for c in LABELS)


@query(
    "label_audit",
    sp.with_(
        sp.PANEL + f""", u AS MATERIALIZED ({_LU}),
s AS (SELECT 'overall' AS dimension, 'ALL' AS "group", label, v FROM u UNION ALL SELECT 'ticker', ticker, label, v FROM u UNION ALL SELECT 'regime', regime, label, v FROM u),
g AS (SELECT dimension, "group", label, count(v) AS n, count(*) FILTER (v = 1) AS pos, count(*) FILTER (v IS NULL) AS miss, count(*) FILTER (v = 1) / nullif(count(v), 0) AS rate FROM s GROUP BY 1, 2, 3)""",
        f"""SELECT dimension, "group", label, n AS sample_size, pos AS positive_count, {r('rate', 'positive_rate')}, miss AS missing_count, {r('miss / (miss + n)', 'missing_rate')}, {BALANCE} AS class_balance,
  coalesce(dimension <> 'overall' AND count(rate) OVER w >= 2 AND max(rate) OVER w - min(rate) OVER w >= 0.25, false) AS varies_materially FROM g WHERE dimension = 'overall' OR n > 0 WINDOW w AS (PARTITION BY dimension, label)""",
    ),
)
def label_audit(spark, sf):
    return shown(au.label_audit(fx.panel(spark, sf), LABELS, ["ticker", "regime"]))


_TH = [("outperformance", t, "forward_20d_excess_return", ">") for t in (0.0, 0.01, 0.02, 0.03, 0.05)] + [("drawdown_risk", t, "forward_20d_drawdown", "<") for t in (-0.05, -0.1, -0.15, -0.2)]


@query(
    "threshold_sensitivity",
    sp.with_(
        sp.LABELLED,
        " UNION ALL ".join(
            f"SELECT '{f}' AS target_family, CAST({t} AS DOUBLE) AS threshold, count({c}) AS sample_size, count(*) FILTER ({c} {op} {t}) AS positive_count, {r(f'count(*) FILTER ({c} {op} {t}) / count({c})', 'positive_rate')} FROM labelled"
            for f, t, c, op in _TH
        ),
    ),
)
def threshold_sensitivity(spark, sf):
    return shown(au.threshold_sensitivity(lb.forward_outcomes(fx.light(spark, sf), "SPY")))


@query(
    "label_overlap",
    sp.with_(
        sp.LABELLED,
        f"""SELECT CAST(label_outperform_20d AS BIGINT) AS outperform_label, CAST(label_drawdown_risk_20d AS BIGINT) AS drawdown_risk_label, count(*) AS sample_size, {r('count(*) / sum(count(*)) OVER ()', 'share_of_total')}
  FROM labelled WHERE label_outperform_20d IS NOT NULL AND label_drawdown_risk_20d IS NOT NULL GROUP BY 1, 2""",
    ),
)
def label_overlap(spark, sf):
    return shown(au.label_overlap(lb.forward_labels(fx.light(spark, sf), "SPY")))


# All usable technical features.
FEATURES = (
    "return_20d", "return_60d", "volatility_20d", "volatility_60d", "max_drawdown_60d", "max_drawdown_120d", "dist_ma_50d", "dist_ma_200d", "volume_z_20d", "volume_z_60d", "rsi_14d",
    "rs_spy_60d", "rs_qqq_60d",
)
FAMILY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(feature), '{'|'.join(w)}') THEN '{n}'" for n, w in au.FAMILIES) + " ELSE 'unknown / other' END"
_FU = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM technical" for c in FEATURES)
PROFILE_SQL = sp.TECHNICAL + f""", fu AS MATERIALIZED ({_FU}),
fp AS (SELECT feature, v, count(*) AS n FROM fu GROUP BY 1, 2),
prof AS MATERIALIZED (SELECT feature, {FAMILY_SQL} AS family, CAST(coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS BIGINT) AS valid_sample_count, 1 - coalesce(sum(n) FILTER (v IS NOT NULL), 0) / sum(n) AS missing_rate, count(v) AS distinct_values,
  coalesce(sum(n) FILTER (v IS NOT NULL), 0) = 0 OR count(v) <= 1 OR max(n) FILTER (v IS NOT NULL) / sum(n) FILTER (v IS NOT NULL) >= 0.95 AS near_constant FROM fp GROUP BY 1)"""


def _profile(spark, sf):
    # Doubles are rounded so that equal values of both engines count as one.
    rows = fx.technical(spark, sf)
    return rows, au.feature_profile(rows, FEATURES)


@query("feature_profile", sp.with_(PROFILE_SQL, f"SELECT feature, family, valid_sample_count, {r('missing_rate')}, near_constant FROM prof"))
def feature_profile(spark, sf):
    return shown(_profile(spark, sf)[1].drop("distinct_values"))


@query(
    "feature_inventory",
    sp.with_(
        PROFILE_SQL,
        f"""SELECT count(*) AS numeric_feature_count, {r('avg(missing_rate)', 'mean_missing_rate')}, count(*) FILTER (missing_rate >= 0.3) AS high_missing_feature_count, count(*) FILTER (near_constant) AS constant_or_near_constant_feature_count,
  (SELECT count(*) FROM technical) AS sample_size, CAST({len(FEATURES)} AS BIGINT) AS feature_count, {r(f'(SELECT count(*) FROM technical) / {len(FEATURES)}', 'sample_to_feature_ratio')} FROM prof""",
    ),
)
def feature_inventory(spark, sf):
    _, profile = _profile(spark, sf)
    return shown(au.feature_inventory(profile, fx.bars(spark, sf), len(FEATURES)))  # a row of features for each bar


@query(
    "feature_families",
    sp.with_(
        PROFILE_SQL,
        f"SELECT family, count(*) AS feature_count, array_to_string(list(feature ORDER BY feature)[1:3], ', ') AS example_features, {r('count(*) / (SELECT count(*) FROM prof)', 'share_of_features')} FROM prof GROUP BY 1",
    ),
)
def feature_families(spark, sf):
    return shown(au.family_summary(_profile(spark, sf)[1]))


@query(
    "feature_warnings",
    sp.with_(
        PROFILE_SQL,
        f"""SELECT * FROM (SELECT 'high_missing' AS warning, count(*) FILTER (missing_rate >= 0.3) AS feature_count FROM prof UNION ALL SELECT 'near_constant', count(*) FILTER (near_constant) FROM prof
  UNION ALL SELECT 'low_sample_ratio', CASE WHEN (SELECT count(*) FROM technical) / {len(FEATURES)} < 10 THEN {len(FEATURES)} ELSE 0 END
  UNION ALL SELECT 'family_concentration', CASE WHEN (SELECT max(c) FROM (SELECT count(*) / (SELECT count(*) FROM prof) AS c FROM prof GROUP BY family)) >= 0.6 THEN {len(FEATURES)} ELSE 0 END
  UNION ALL SELECT 'complex_features', CASE WHEN (SELECT count(*) FROM technical) / {len(FEATURES)} < 20 THEN count(*) FILTER (family LIKE 'Fourier%') ELSE 0 END FROM prof) WHERE feature_count > 0""",
    ),
)
def feature_warnings(spark, sf):
    _, profile = _profile(spark, sf)
    return au.feature_warnings(profile, au.feature_inventory(profile, fx.bars(spark, sf), len(FEATURES)))


ROLES = {"regime": fixed.REGIME_COLUMNS, "momentum": fixed.MOMENTUM_COLUMNS, "outcome": fixed.OUTCOME_COLUMNS, "none": ("market_regime", "momentum_60d")}


def _available_sql() -> str:
    """Names that the panel does not have are left out by hand: SQL can't ask for them."""
    there = {"regime": ("regime",), "momentum": ("rs_qqq_60d", "rs_spy_60d", "rs_qqq_120d", "rs_spy_120d"), "outcome": fixed.OUTCOME_COLUMNS, "none": ()}
    picks = [f"SELECT '{role}' AS role, CAST({'CASE ' + ' '.join(f'WHEN count({c}) > 0 THEN {chr(39)}{c}{chr(39)}' for c in names) + ' END' if names else 'NULL'} AS VARCHAR) AS picked FROM panel" for role, names in there.items()]
    return " UNION ALL ".join(picks[:3] + ["SELECT 'none', CAST(NULL AS VARCHAR)"])


@query("available_columns", sp.with_(sp.PANEL, _available_sql()))
def available_columns(spark, sf):
    """The first available candidate of each role."""
    picked = au.first_available(fx.panel(spark, sf), *ROLES.values())
    return spark.createDataFrame(list(zip(ROLES, picked)), "role string, picked string")


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query("correlation_pairs", sp.with_(sp.TECHNICAL, " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {r(f'abs(corr({a}, {b}))', 'abs_correlation')} FROM technical" for a, b in _PAIRS)))
def correlation_pairs(spark, sf):
    return shown(au.correlation_pairs(fx.technical(spark, sf), FEATURES))


@query(
    "redundancy_top",
    sp.with_(
        sp.TECHNICAL + ", cp AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(abs(corr({a}, {b})), 6) AS c FROM technical" for a, b in _PAIRS) + ")",
        f"SELECT feature_1, feature_2, {r('c', 'abs_correlation')} FROM cp WHERE c >= 0.6 ORDER BY c DESC, feature_1, feature_2 LIMIT 10",
    ),
)
def redundancy_top(spark, sf):
    """Top ten of the pairs above a threshold (0.6 here; the default is 0.95)."""
    pairs = shown(au.correlation_pairs(fx.technical(spark, sf), FEATURES)).filter("abs_correlation >= 0.6")
    return pairs.orderBy(F.col("abs_correlation").desc(), "feature_1", "feature_2").limit(10)


@query("redundancy_selection")
def redundancy_selection(spark, sf):
    """Greedy prune of the transform features; the walk is over column pairs only."""
    from tickerloom.operators import transforms as tr

    rows = tr.wavelet(tr.fourier(fx.bars(spark, sf)))
    rows = settle(rows.select(*[c for c in rows.columns if c.startswith(("fourier_", "wavelet_"))]).drop("wavelet_available"))
    out = []
    for prefix in ("fourier_", "wavelet_"):
        columns = [c for c in rows.columns if c.startswith(prefix)]
        out += [(prefix.rstrip("_"), d, k, float(round(c, 6))) for d, k, c in au.redundant(rows, columns)]
    return spark.createDataFrame(out, "family string, dropped_feature string, kept_feature string, abs_correlation double")


SIGNALS = ("return_20d", "return_60d", "volatility_20d", "volatility_60d")
_SU = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, forward_20d_excess_return AS t, label_outperform_20d AS a, label_drawdown_risk_20d AS b FROM labelled WHERE {c} IS NOT NULL" for c in SIGNALS)


def _rk(x: str, part: str = "feature") -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0"


SIGNAL_SQL = sp.LABELLED + f""", su AS MATERIALIZED ({_SU}),
s1 AS (SELECT feature, count(*) AS n, corr(x, y) AS rho FROM (SELECT feature, {_rk('v')} AS x, {_rk('t')} AS y FROM su WHERE t IS NOT NULL) GROUP BY 1),
s2 AS (SELECT feature, abs(corr(x, a)) AS ra FROM (SELECT feature, a, {_rk('v')} AS x FROM su WHERE a IS NOT NULL) GROUP BY 1),
s3 AS (SELECT feature, abs(corr(x, b)) AS rb FROM (SELECT feature, b, {_rk('v')} AS x FROM su WHERE b IS NOT NULL) GROUP BY 1),
q AS (SELECT feature, quantile_cont(v, 0.2) AS q1, quantile_cont(v, 0.8) AS q4 FROM su WHERE t IS NOT NULL GROUP BY 1),
s4 AS (SELECT feature, avg(t) FILTER (v <= q1) AS lo, avg(t) FILTER (v > q4) AS hi FROM su JOIN q USING (feature) WHERE t IS NOT NULL GROUP BY 1),
sig AS MATERIALIZED (SELECT *, {FAMILY_SQL} AS family FROM s1 JOIN s2 USING (feature) JOIN s3 USING (feature) JOIN s4 USING (feature))"""


def _signal(spark, sf):
    rows = lb.forward_labels(fx.light(spark, sf), "SPY").select(*SIGNALS, "forward_20d_excess_return", *LABELS)
    with passing(spark):
        return settle(au.feature_signal(stored(rows), SIGNALS))


@query(
    "feature_signal",
    sp.with_(
        SIGNAL_SQL,
        f"""SELECT feature, family, n AS valid_sample_count, {r('abs(rho)', 'abs_spearman_to_return_target')}, {r('rho', 'spearman_to_return_target')}, {r('ra', 'abs_spearman_to_return_label')}, {r('rb', 'abs_spearman_to_drawdown_label')},
  {r('hi', 'top_quantile_target_mean')}, {r('lo', 'bottom_quantile_target_mean')}, {r('hi - lo', 'quantile_spread')}, CASE WHEN greatest(abs(rho), ra, rb) < 0.05 THEN 'near zero' WHEN greatest(abs(rho), ra, rb) >= 0.2 THEN 'strong' ELSE 'modest' END AS signal_read FROM sig""",
    ),
)
def feature_signal(spark, sf):
    return shown(_signal(spark, sf).drop("unique_value_count"))


@query(
    "top_signals",
    sp.with_(SIGNAL_SQL, f"SELECT feature, family, {r('greatest(abs(rho), ra, rb)', 'strength')} FROM sig ORDER BY round(greatest(abs(rho), ra, rb), 12) DESC, feature LIMIT 3"),
)
def top_signals(spark, sf):
    return shown(au.top_signals(_signal(spark, sf), 3).select("feature", "family", au.signal_strength().alias("strength")))


@query(
    "quantile_signals",
    sp.with_(
        SIGNAL_SQL,
        f"""SELECT feature, family, n AS valid_sample_count, {r('lo', 'bottom_quantile_target_mean')}, {r('hi', 'top_quantile_target_mean')}, {r('hi - lo', 'quantile_spread')}, {r('abs(hi - lo)', 'abs_quantile_spread')}
FROM sig ORDER BY round(abs(hi - lo), 12) DESC, feature LIMIT 3""",
    ),
)
def quantile_signals(spark, sf):
    return shown(au.quantile_signals(_signal(spark, sf), 3))


@query(
    "signal_warnings",
    sp.with_(
        SIGNAL_SQL + """, sw AS (SELECT *, greatest(abs(rho), ra, rb) AS s, row_number() OVER (ORDER BY round(greatest(abs(rho), ra, rb), 12) DESC, feature) AS p FROM sig),
w1 AS (SELECT 'near-zero univariate signal' AS warning, count(*) FILTER (s < 0.05) AS feature_count, 'threshold=0.05' AS detail FROM sw HAVING count(*) FILTER (s < 0.05) / count(*) >= 0.75),
w2 AS (SELECT 'top signal features are redundant' AS warning, count(*) AS feature_count, string_agg(feature, ', ' ORDER BY feature) AS detail FROM sw WHERE p <= 5 AND feature IN ('volatility_20d', 'volatility_60d') HAVING count(*) > 0),
w3 AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2)""",
        """SELECT warning, 'info' AS severity, feature_count, detail FROM w3 UNION ALL SELECT 'no material feature signal warnings', 'info', 0, '' WHERE NOT EXISTS (SELECT 1 FROM w3)""",
    ),
)
def signal_warnings(spark, sf):
    signal = _signal(spark, sf)
    return shown(au.signal_warnings(signal, au.family_signal(signal), ("volatility_20d", "volatility_60d")))


@query(
    "family_signal",
    sp.with_(
        SIGNAL_SQL,
        f"""SELECT family, count(*) AS feature_count, {r('median(abs(rho))', 'median_abs_signal')}, {r('max(abs(rho))', 'max_abs_signal')}, arg_max(feature, abs(rho)) AS top_feature, {r(f'count(*) / {len(SIGNALS)}', 'share_of_top_features')} FROM sig GROUP BY 1""",
    ),
)
def family_signal(spark, sf):
    return shown(au.family_signal(_signal(spark, sf)))


IMPORTANT = ("return_20d", "return_60d", "volatility_20d", "volatility_60d", "px_spy")
_IMP = " UNION ALL ".join(
    f"SELECT '{t}' AS target, '{m}' AS model, fold, '{c}' AS feature, round(abs(corr({c}, {y})), 9) AS abs_importance FROM ir GROUP BY fold"
    for t, m, y in (("outperformance", "label_link", "label_outperform_20d"), ("outperformance", "return_link", "forward_20d_return"), ("drawdown_risk", "label_link", "label_drawdown_risk_20d"))
    for c in IMPORTANT
)
IMPORTANCE_SQL = sp.LABELLED + "," + sp.FOLDS + f""",
ir AS MATERIALIZED (SELECT fold, {", ".join(IMPORTANT)}, label_outperform_20d, label_drawdown_risk_20d, forward_20d_return FROM labelled l JOIN folds f ON l.date BETWEEN f.test_start AND f.test_end),
imp AS MATERIALIZED (SELECT * FROM ({_IMP}) WHERE abs_importance IS NOT NULL AND NOT isnan(abs_importance)),
ip_a AS (SELECT target, model, fold, feature, {FAMILY_SQL} AS feature_family, abs_importance / sum(abs_importance) OVER (PARTITION BY target, model, fold) AS v FROM imp),
ip AS MATERIALIZED (SELECT * FROM ip_a UNION ALL SELECT target, 'all_selected_models', fold, feature, feature_family, v FROM ip_a WHERE target = 'outperformance'),
it AS (SELECT *, v >= quantile_cont(v, 0.9) OVER (PARTITION BY target, model, fold) AS top FROM ip),
st_a AS (SELECT target, model, feature, feature_family, count(DISTINCT fold) AS fold_count, avg(v) AS mean_importance, stddev_pop(v) AS std_importance, count(DISTINCT fold) FILTER (v > 0) AS positive_fold_count, count(DISTINCT fold) FILTER (top) AS top_decile_fold_count FROM it GROUP BY 1, 2, 3, 4),
stab AS MATERIALIZED (SELECT *, std_importance / mean_importance AS importance_cv, CASE WHEN fold_count < 3 THEN 'insufficient_data' WHEN top_decile_fold_count / fold_count >= 0.6 AND std_importance / mean_importance <= 1 AND positive_fold_count / fold_count >= 0.6 THEN 'stable'
  WHEN top_decile_fold_count <= 1 OR std_importance / mean_importance > 2 THEN 'unstable' ELSE 'mixed' END AS classification FROM st_a)"""


def _importance(spark, sf):
    """Per-fold |correlation| of a feature with a label as its importance."""
    rows = lb.forward_labels(fx.light(spark, sf), "SPY")
    days = fx.shipping_days(spark, sf)
    tested = fo.assign(rows, fx.fold_bounds(spark, sf), "test", days)
    links = (("outperformance", "label_link", "label_outperform_20d"), ("outperformance", "return_link", "forward_20d_return"), ("drawdown_risk", "label_link", "label_drawdown_risk_20d"))
    one = tested.groupBy("fold").agg(*[F.round(F.abs(correlation(F.col(c), F.col(y))), 9).alias(f"{t}|{m}|{c}") for t, m, y in links for c in IMPORTANT])
    entries = [
        F.struct(F.lit(t).alias("target"), F.lit(m).alias("model"), F.lit(c).alias("feature"), F.col(f"`{t}|{m}|{c}`").alias("abs_importance")) for t, m, _ in links for c in IMPORTANT
    ]
    return settle(one.select("fold", F.inline(F.array(*entries))).filter("abs_importance IS NOT NULL AND NOT isnan(abs_importance)"))


@query(
    "importance_stability",
    sp.with_(IMPORTANCE_SQL, f"SELECT target, model, feature, feature_family, fold_count, {rs('mean_importance, std_importance, importance_cv')}, positive_fold_count, top_decile_fold_count, classification FROM stab"),
)
def importance_stability(spark, sf):
    return shown(au.importance_stability(au.prepared_importance(_importance(spark, sf))))


@query(
    "family_importance",
    sp.with_(
        IMPORTANCE_SQL + """,
fa AS (SELECT target, model, fold, feature_family, round(sum(v), 12) AS v, count(DISTINCT feature) AS k FROM ip GROUP BY 1, 2, 3, 4),
fb AS (SELECT *, v = max(v) OVER (PARTITION BY target, model, fold) AS top FROM fa),
fc AS (SELECT target, model, feature_family, max(k) AS feature_count, count(DISTINCT fold) AS fold_count, avg(v) AS m, stddev_pop(v) AS s, count(DISTINCT fold) FILTER (top) AS t FROM fb GROUP BY 1, 2, 3)""",
        f"""SELECT target, model, feature_family, feature_count, fold_count, {r('m', 'mean_family_importance')}, {r('s', 'std_family_importance')}, t AS top_family_fold_count,
  CASE WHEN fold_count < 3 THEN 'insufficient_data' WHEN t / fold_count >= 0.6 AND s / m <= 1 THEN 'stable' WHEN t <= 1 OR s / m > 2 THEN 'unstable' ELSE 'mixed' END AS classification FROM fc""",
    ),
)
def family_importance(spark, sf):
    return shown(au.family_importance(au.prepared_importance(_importance(spark, sf))))


@query(
    "importance_readiness",
    sp.with_(
        IMPORTANCE_SQL,
        """SELECT target, model, s AS stable_feature_count, m AS mixed_feature_count, u AS unstable_feature_count, coalesce(top, '') AS top_stable_features,
  CASE WHEN k = 0 THEN 'insufficient_data' WHEN s >= 3 AND u <= s THEN 'promising' WHEN s > 0 THEN 'watch' ELSE 'not_ready' END AS classification FROM (
  SELECT target, model, count(*) FILTER (classification = 'stable') AS s, count(*) FILTER (classification = 'mixed') AS m, count(*) FILTER (classification = 'unstable') AS u, count(*) FILTER (classification <> 'insufficient_data') AS k,
    array_to_string((list(feature ORDER BY mean_importance DESC, feature) FILTER (classification = 'stable'))[1:5], ', ') AS top FROM stab GROUP BY 1, 2)""",
    ),
)
def importance_readiness(spark, sf):
    return au.importance_readiness(au.importance_stability(au.prepared_importance(_importance(spark, sf))))


@query("walk_forward_folds", sp.with_(sp.FOLDS, "SELECT * FROM folds"))
def walk_forward_folds(spark, sf):
    return fx.fold_bounds(spark, sf)


@query(
    "fold_assignment",
    sp.with_(
        sp.BARS + "," + sp.FOLDS,
        "SELECT fold, 'train' AS part, count(*) AS n, count(DISTINCT ticker) AS tickers FROM bars JOIN folds ON date BETWEEN train_start AND train_end GROUP BY fold "
        "UNION ALL SELECT fold, 'test', count(*), count(DISTINCT ticker) FROM bars JOIN folds ON date BETWEEN test_start AND test_end GROUP BY fold",
    ),
)
def fold_assignment(spark, sf):
    bars, days, bounds = fx.bars(spark, sf), fx.shipping_days(spark, sf), fx.fold_bounds(spark, sf)
    parts = [
        fo.assign(bars, bounds, p, days).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers")).select("fold", F.lit(p).alias("part"), "n", "tickers")
        for p in ("train", "test")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "leakage",
    sp.with_(
        sp.FOLDS,
        """SELECT 'train_test_gap' AS diagnostic, CAST(20 AS BIGINT) AS label_horizon_days, count(DISTINCT fold) AS fold_count, min(datediff('day', train_end, test_start)) AS min_train_test_gap_days, CAST(20 AS BIGINT) AS required_embargo_days,
  CASE WHEN min(datediff('day', train_end, test_start)) < 20 THEN 'high' WHEN min(datediff('day', train_end, test_start)) < 30 THEN 'thin' ELSE 'low' END AS overlap_risk,
  CASE WHEN min(datediff('day', train_end, test_start)) < 20 THEN 'risky' WHEN min(datediff('day', train_end, test_start)) < 30 THEN 'watch' ELSE 'clean' END AS classification FROM folds""",
    ),
)
def leakage(spark, sf):
    return shown(au.leakage(fx.fold_bounds(spark, sf), 20, fx.EMBARGO))


FS = "mean_roc_auc, std_roc_auc, mean_pr_auc, std_pr_auc, mean_brier, std_brier, best_fold_metric, worst_fold_metric, fold_instability"


@query(
    "fold_stability",
    sp.with_(
        sp.SCORES + "," + metrics_sql("a", "scores", "fold", "actual_out", "probability_out") + "," + metrics_sql("b", "scores", "fold", "actual_risk", "probability_risk") + """,
z AS (SELECT 'outperformance' AS target, fold, auc, ap, brier FROM a UNION ALL SELECT 'drawdown_risk', fold, auc, ap, brier FROM b),
y AS (SELECT target, count(DISTINCT fold) AS fold_count, avg(auc) AS mean_roc_auc, CASE WHEN count(auc) > 1 THEN stddev_pop(auc) END AS std_roc_auc, avg(ap) AS mean_pr_auc, CASE WHEN count(ap) > 1 THEN stddev_pop(ap) END AS std_pr_auc,
  avg(brier) AS mean_brier, CASE WHEN count(brier) > 1 THEN stddev_pop(brier) END AS std_brier, max(auc) AS best_fold_metric, min(auc) AS worst_fold_metric, max(auc) - min(auc) AS fold_instability FROM z GROUP BY 1)""",
        f"""SELECT target, fold_count, {rs(FS)}, CASE WHEN fold_count < 3 THEN 'insufficient_data' WHEN std_roc_auc > 0.08 OR fold_instability > 0.15 OR std_brier > 0.04 THEN 'unstable'
  WHEN std_roc_auc > 0.04 OR fold_instability > 0.08 OR std_brier > 0.02 THEN 'mixed' ELSE 'stable' END AS classification FROM y""",
    ),
)
def fold_stability(spark, sf):
    s = stored(fx.scores(spark, sf))
    parts = [
        mt.binary_metrics(s, ["fold"], y, p).withColumn("target", F.lit(t))
        for t, y, p in (("outperformance", "actual_out", "probability_out"), ("drawdown_risk", "actual_risk", "probability_risk"))
    ]
    return shown(au.fold_stability(parts[0].unionByName(parts[1])))


@query(
    "overfit_warnings",
    sp.with_(
        sp.REGIME_SCORES + """,
e AS (SELECT quantile_cont(probability_out, 1 / 3) AS q1, quantile_cont(probability_out, 2 / 3) AS q2 FROM scores),
o AS (SELECT count(*) AS n, count(DISTINCT ticker) AS t, count(DISTINCT regime) AS g, avg(actual_out) AS rate, avg(forward_excess_return) FILTER (probability_out > q2) - avg(forward_excess_return) FILTER (probability_out <= q1) AS s FROM scores, e),
c AS (SELECT (SELECT max(k) / sum(k) FROM (SELECT count(*) AS k FROM scores GROUP BY ticker)) AS ts, (SELECT max(k) / sum(k) FROM (SELECT count(*) AS k FROM scores GROUP BY regime)) AS gs)""",
        f"""SELECT n AS sample_count, t AS ticker_count, g AS regime_count, {r('rate', 'positive_rate')}, {r('s', 'bucket_spread')}, d AS diagnostic, CASE d WHEN 'sample_coverage' THEN CASE WHEN n < 100 OR t < 3 THEN 'insufficient_data' ELSE 'low_risk' END
  WHEN 'ticker_concentration' THEN CASE WHEN ts > 0.5 THEN 'likely_overfit' WHEN t < 3 THEN 'insufficient_data' ELSE 'low_risk' END WHEN 'regime_concentration' THEN CASE WHEN gs > 0.7 THEN 'watch' WHEN g < 2 THEN 'insufficient_data' ELSE 'low_risk' END
  ELSE CASE WHEN abs(s) <= 0.0025 THEN 'watch' WHEN s < -0.0025 THEN 'likely_overfit' ELSE 'low_risk' END END AS classification
  FROM o, c, (SELECT unnest(['sample_coverage', 'ticker_concentration', 'regime_concentration', 'bucket_spread_support']) AS d)""",
    ),
)
def overfit_warnings(spark, sf):
    s = fx.scores(spark, sf, True).withColumns({"probability": F.col("probability_out"), "actual": F.col("actual_out")})
    return shown(au.overfit_warnings(stored(s)))


def rates_sql(label: str, actual: str, prob: str) -> str:
    return sp.REGIME_SCORES + f""",
cr_t AS MATERIALIZED (SELECT fold, date, ticker, {label} AS label, regime, return_60d AS momentum FROM panel p JOIN folds f ON p.date BETWEEN f.train_start AND f.train_end WHERE {label} IS NOT NULL),
cr_e AS (SELECT fold, quantile_cont(momentum, 0.25) AS q1, quantile_cont(momentum, 0.5) AS q2, quantile_cont(momentum, 0.75) AS q3 FROM cr_t WHERE momentum IS NOT NULL GROUP BY 1),
cr_b AS MATERIALIZED (SELECT t.*, CASE WHEN momentum IS NOT NULL THEN (momentum > q1)::INT + (momentum > q2)::INT + (momentum > q3)::INT END AS bucket FROM cr_t t LEFT JOIN cr_e USING (fold)),
cr_g AS (SELECT fold, avg(label) AS g FROM cr_b GROUP BY 1),
cr_r AS (SELECT fold, regime, avg(label) AS pr FROM cr_b GROUP BY 1, 2 HAVING count(*) >= 20 AND count(*) FILTER (label = 1) >= 5 AND count(*) FILTER (label = 0) >= 5),
cr_m AS (SELECT fold, bucket, avg(label) AS pm FROM cr_b WHERE bucket IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20 AND count(*) FILTER (label = 1) >= 5 AND count(*) FILTER (label = 0) >= 5),
cr_x AS (SELECT fold, regime, bucket, avg(label) AS px FROM cr_b WHERE bucket IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 20 AND count(*) FILTER (label = 1) >= 5 AND count(*) FILTER (label = 0) >= 5),
cr_s AS (SELECT s.fold, s.date, s.ticker, s.regime, {actual} AS actual, {prob} AS model, forward_excess_return, CASE WHEN return_60d IS NOT NULL THEN (return_60d > q1)::INT + (return_60d > q2)::INT + (return_60d > q3)::INT END AS bucket FROM scores s LEFT JOIN cr_e USING (fold)),
rates AS MATERIALIZED (SELECT s.*, g AS global_fold_prevalence, coalesce(pr, g) AS regime_fold_prevalence, coalesce(pm, g) AS momentum_bucket_prevalence, coalesce(px, pr, g) AS regime_momentum_bucket_prevalence,
  pr IS NULL AS regime_fallback, pm IS NULL AS momentum_fallback, px IS NULL AS regime_momentum_fallback FROM cr_s s JOIN cr_g USING (fold) LEFT JOIN cr_r r ON s.fold = r.fold AND s.regime = r.regime
  LEFT JOIN cr_m m ON s.fold = m.fold AND s.bucket = m.bucket LEFT JOIN cr_x x ON s.fold = x.fold AND s.regime = x.regime AND s.bucket = x.bucket)"""


def rates_of_labels_sql(labels, prob: str, source: str) -> str:
    """``rates_sql`` for several labels of a table at once; ``lid`` names the label."""
    union = " UNION ALL ".join(f"SELECT '{c}' AS lid, ticker, date, {c} AS label, regime, return_60d AS momentum FROM {source} WHERE {c} IS NOT NULL" for c in labels)
    enough = "HAVING count(*) >= 20 AND count(*) FILTER (label = 1) >= 5 AND count(*) FILTER (label = 0) >= 5"
    bucket = "CASE WHEN {m} IS NOT NULL THEN ({m} > q1)::INT + ({m} > q2)::INT + ({m} > q3)::INT END AS bucket"
    return f""",
cr_l AS MATERIALIZED ({union}),
cr_t AS MATERIALIZED (SELECT fold, l.* FROM cr_l l JOIN folds f ON l.date BETWEEN f.train_start AND f.train_end),
cr_e AS (SELECT lid, fold, quantile_cont(momentum, 0.25) AS q1, quantile_cont(momentum, 0.5) AS q2, quantile_cont(momentum, 0.75) AS q3 FROM cr_t WHERE momentum IS NOT NULL GROUP BY 1, 2),
cr_b AS MATERIALIZED (SELECT t.*, {bucket.format(m='momentum')} FROM cr_t t LEFT JOIN cr_e USING (lid, fold)),
cr_g AS (SELECT lid, fold, avg(label) AS g FROM cr_b GROUP BY 1, 2),
cr_r AS (SELECT lid, fold, regime, avg(label) AS pr FROM cr_b GROUP BY 1, 2, 3 {enough}),
cr_m AS (SELECT lid, fold, bucket, avg(label) AS pm FROM cr_b WHERE bucket IS NOT NULL GROUP BY 1, 2, 3 {enough}),
cr_x AS (SELECT lid, fold, regime, bucket, avg(label) AS px FROM cr_b WHERE bucket IS NOT NULL GROUP BY 1, 2, 3, 4 {enough}),
cr_s AS (SELECT l.lid, s.fold, s.date, s.ticker, s.regime, l.label AS actual, {prob} AS model, forward_excess_return, {bucket.format(m='return_60d')}
  FROM scores s JOIN cr_l l ON l.ticker = s.ticker AND l.date = s.date LEFT JOIN cr_e e ON e.lid = l.lid AND e.fold = s.fold),
rates AS MATERIALIZED (SELECT s.*, g AS global_fold_prevalence, coalesce(pr, g) AS regime_fold_prevalence, coalesce(pm, g) AS momentum_bucket_prevalence, coalesce(px, pr, g) AS regime_momentum_bucket_prevalence,
  pr IS NULL AS regime_fallback, pm IS NULL AS momentum_fallback, px IS NULL AS regime_momentum_fallback FROM cr_s s JOIN cr_g USING (lid, fold) LEFT JOIN cr_r r ON s.lid = r.lid AND s.fold = r.fold AND s.regime = r.regime
  LEFT JOIN cr_m m ON s.lid = m.lid AND s.fold = m.fold AND s.bucket = m.bucket LEFT JOIN cr_x x ON s.lid = x.lid AND s.fold = x.fold AND s.regime = x.regime AND s.bucket = x.bucket)"""


def _rates_of_labels(spark, sf, panel, labels, prob):
    """Prevalences next to the scores for each label of a panel; one probability formula serves all of them."""
    both = released(panel.select(*dict.fromkeys([*fx.RATE_INPUTS, *labels])))
    panel = both.select("ticker", "date", *labels, "regime", F.col("return_60d").alias("momentum"))
    s = fx.scored(spark, sf, both, True).select("fold", "date", "ticker", "regime", F.col(prob).alias("probability"), F.col("return_60d").alias("momentum"), "forward_excess_return")
    entries = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("actual")) for c in labels])
    actual = panel.select("ticker", "date", F.inline(entries)).filter("actual IS NOT NULL")
    return ch.fold_rates(s.join(actual, ["ticker", "date"]), panel, fx.fold_bounds(spark, sf), labels)


def _rates(spark, sf, label, actual, prob):
    both = released(fx.panel(spark, sf, fx.RATE_INPUTS).select(*fx.RATE_INPUTS))  # history and scores from one pass over the features
    panel = both.select("ticker", "date", F.col(label).alias("label"), "regime", F.col("return_60d").alias("momentum"))
    s = fx.scored(spark, sf, both, True).select(
        "fold", "date", "ticker", "regime", F.col(actual).alias("actual"), F.col(prob).alias("probability"), F.col("return_60d").alias("momentum"), "forward_excess_return"
    )
    return ch.fold_rates(s, panel, fx.fold_bounds(spark, sf))


RATE = "model, global_fold_prevalence, regime_fold_prevalence, momentum_bucket_prevalence, regime_momentum_bucket_prevalence"
OPP = ("label_outperform_20d", "actual_out", "probability_out")


@query("fold_rates", sp.with_(rates_sql(*OPP), f"SELECT fold, date, ticker, {rs(RATE)}, regime_fallback, momentum_fallback, regime_momentum_fallback FROM rates"))
def fold_rates(spark, sf):
    return shown(_rates(spark, sf, *OPP), "fold", "date", "ticker", *RATE.split(", "), "regime_fallback", "momentum_fallback", "regime_momentum_fallback")


def _worst(g: str) -> str:
    return f"""w_{g} AS (SELECT comparator, arg_min({g}, (-br, {g})) AS worst_{g}, max(br) AS worst_{g}_brier FROM (SELECT comparator, {g}, round(avg((p - actual) ^ 2), 12) AS br FROM cu GROUP BY 1, 2) GROUP BY 1)"""


def comparator_sql(names: tuple[str, ...]) -> str:
    union = " UNION ALL ".join(f"SELECT '{c}' AS comparator, {c} AS p, {ch.FALLBACKS.get(c, 'false')} AS fb, fold, ticker, regime, actual FROM rates" for c in names)
    return f""", cu AS MATERIALIZED ({union}),{metrics_sql('m', 'cu', 'comparator', 'actual', 'p')},
cu_c AS (SELECT comparator, count(DISTINCT ticker) AS ticker_count, count(DISTINCT fold) AS fold_count, count(*) FILTER (fb) AS fallback_count FROM cu GROUP BY 1), {_worst('regime')}, {_worst('fold')}, {_worst('ticker')},
cm AS MATERIALIZED (SELECT * FROM m JOIN cu_c USING (comparator) JOIN w_regime USING (comparator) JOIN w_fold USING (comparator) JOIN w_ticker USING (comparator)),
cd AS (SELECT c.*, c.rate - c.mp AS gap, x.ap AS map, x.brier AS mbrier, x.rate - x.mp AS mgap, x.worst_fold_brier AS mwf, x.worst_regime_brier AS mwr FROM cm c, (SELECT * FROM cm WHERE comparator = 'model') x)"""


_C = """comparator, n AS sample_count, ticker_count, fold_count, fallback_count, {0}, worst_regime, worst_fold, worst_ticker""".format(
    ", ".join([r("rate", "positive_rate"), r("mp", "mean_probability"), r("gap", "calibration_gap"), r("brier", "brier_score"), r("auc", "roc_auc"), r("c_ap", "pr_auc")])
)
CH_COLUMNS = ["comparator", "sample_count", "ticker_count", "fold_count", "fallback_count", "positive_rate", "mean_probability", "calibration_gap", "brier_score", "roc_auc", "pr_auc", "worst_regime", "worst_fold", "worst_ticker", "classification"]


@query(
    "opportunity_challenge",
    sp.with_(
        rates_sql(*OPP) + comparator_sql(ch.COMPARATORS) + """,
ce AS (SELECT *, ap AS c_ap, (map > ap + 0.01)::INT + (mbrier + 0.0025 < brier)::INT + (abs(mgap) + 0.025 < abs(gap))::INT + (mwf + 0.01 < worst_fold_brier)::INT + (mwr + 0.01 < worst_regime_brier)::INT AS won,
  (ap > map + 0.01)::INT + (brier + 0.0025 < mbrier)::INT + (abs(gap) + 0.025 < abs(mgap))::INT + (worst_fold_brier + 0.01 < mwf)::INT + (worst_regime_brier + 0.01 < mwr)::INT AS lost FROM cd),
cf AS (SELECT *, CASE WHEN won >= 3 AND lost <= 1 THEN 'model_beats_baseline' WHEN lost >= 3 AND won <= 1 THEN 'baseline_beats_model' WHEN greatest(won, lost) <= 2 THEN 'baseline_matches_model' ELSE 'unstable_or_inconclusive' END AS c FROM ce),
cg AS (SELECT CASE WHEN bool_or(c = 'baseline_beats_model') THEN 'baseline_beats_model' WHEN bool_or(c = 'unstable_or_inconclusive') THEN 'unstable_or_inconclusive' WHEN bool_and(c = 'model_beats_baseline') THEN 'model_beats_baseline' ELSE 'baseline_matches_model' END AS v FROM cf WHERE comparator <> 'model')""",
        f"SELECT {_C}, CASE WHEN comparator = 'model' THEN v ELSE c END AS classification FROM cf, cg",
    ),
)
def opportunity_challenge(spark, sf):
    metrics = ch.comparator_metrics(released(_rates(spark, sf, *OPP)), ch.COMPARATORS, few=True)
    return shown(ch.challenge(settle(metrics)), *CH_COLUMNS)


@query(
    "prevalence_baseline",
    sp.with_(
        rates_sql("label_drawdown_risk_20d", "actual_risk", "probability_risk") + comparator_sql(ch.COMPARATORS[:3]) + """,
ce AS (SELECT *, ap AS c_ap, (mbrier + 0.0025 < brier)::INT + (abs(mgap) + 0.025 < abs(gap))::INT + (mwf + 0.01 < worst_fold_brier)::INT AS won, (brier + 0.0025 < mbrier)::INT + (abs(gap) + 0.025 < abs(mgap))::INT + (worst_fold_brier + 0.01 < mwf)::INT AS lost FROM cd),
cf AS (SELECT *, CASE WHEN won >= 2 AND lost = 0 THEN 'model_beats_baseline' WHEN lost >= 2 AND won = 0 THEN 'baseline_beats_model' ELSE 'baseline_matches_model' END AS c FROM ce),
cg AS (SELECT CASE WHEN bool_or(c = 'baseline_beats_model') THEN 'baseline_beats_model' WHEN bool_and(c = 'model_beats_baseline') THEN 'model_beats_baseline' ELSE 'baseline_matches_model' END AS v FROM cf WHERE comparator <> 'model')""",
        f"SELECT {_C}, CASE WHEN comparator = 'model' THEN v ELSE c END AS classification FROM cf, cg",
    ),
)
def prevalence_baseline(spark, sf):
    rates = stored(_rates(spark, sf, "label_drawdown_risk_20d", "actual_risk", "probability_risk"))
    return shown(ch.prevalence_rule(settle(ch.comparator_metrics(rates, ch.COMPARATORS[:3], few=True))), *CH_COLUMNS)


_METRICS = (("rate", "positive_rate"), ("mp", "mean_probability"), ("gap", "calibration_gap"), ("brier", "brier_score"), ("auc", "roc_auc"), ("ap", "pr_auc"))


def challenge_by_sql(name: str, source: str) -> str:
    """The challenge per key ``vk`` of ``source``, from the rule: comparators become rows keyed by vk and name."""
    union = " UNION ALL ".join(f"SELECT vk, '{c}' AS comparator, vk || '#{c}' AS k, {c} AS p, {ch.FALLBACKS.get(c, 'false')} AS fb, fold, ticker, regime, actual FROM {source}" for c in ch.COMPARATORS)
    worst = ", ".join(
        f"{name}_{g} AS (SELECT k, arg_min({g}, (-br, {g})) AS worst_{g}, max(br) AS worst_{g}_brier FROM (SELECT k, {g}, round(avg((p - actual) ^ 2), 12) AS br FROM {name}_u GROUP BY 1, 2) GROUP BY 1)"
        for g in ("regime", "fold", "ticker")
    )
    five = (("x.ap > c.ap + 0.01", "c.ap > x.ap + 0.01"), ("x.brier + 0.0025 < c.brier", "c.brier + 0.0025 < x.brier"), ("abs(x.gap) + 0.025 < abs(c.gap)", "abs(c.gap) + 0.025 < abs(x.gap)")) + tuple(
        (f"x.worst_{g}_brier + 0.01 < c.worst_{g}_brier", f"c.worst_{g}_brier + 0.01 < x.worst_{g}_brier") for g in ("fold", "regime")
    )
    won, lost = (" + ".join(f"({t[i]})::INT" for t in five) for i in (0, 1))
    return f""", {name}_u AS MATERIALIZED ({union}),{metrics_sql(name + '_m', name + '_u', 'k', 'actual', 'p')}, {worst},
{name}_n AS (SELECT k, any_value(vk) AS vk, any_value(comparator) AS comparator, count(DISTINCT ticker) AS ticker_count, count(DISTINCT fold) AS fold_count, count(*) FILTER (fb) AS fallback_count FROM {name}_u GROUP BY 1),
{name}_c AS MATERIALIZED (SELECT *, rate - mp AS gap FROM {name}_m JOIN {name}_n USING (k) JOIN {name}_regime USING (k) JOIN {name}_fold USING (k) JOIN {name}_ticker USING (k)),
{name}_d AS (SELECT c.*, {won} AS won, {lost} AS lost FROM {name}_c c JOIN (SELECT * FROM {name}_c WHERE comparator = 'model') x USING (vk)),
{name}_e AS (SELECT *, CASE WHEN won IS NULL OR lost IS NULL THEN 'insufficient_evidence' WHEN won >= 3 AND lost <= 1 THEN 'model_beats_baseline' WHEN lost >= 3 AND won <= 1 THEN 'baseline_beats_model'
  WHEN greatest(won, lost) <= 2 THEN 'baseline_matches_model' ELSE 'unstable_or_inconclusive' END AS cl FROM {name}_d),
{name}_v AS (SELECT vk, count(*) FILTER (cl = 'baseline_beats_model') AS n_loss, count(*) FILTER (cl = 'baseline_matches_model') AS n_match, count(*) FILTER (cl = 'model_beats_baseline') AS n_win, count(*) FILTER (cl = 'unstable_or_inconclusive') AS n_odd,
  CASE WHEN bool_and(cl = 'insufficient_evidence') THEN 'insufficient_evidence' WHEN bool_or(cl = 'baseline_beats_model') THEN 'baseline_beats_model' WHEN bool_or(cl = 'unstable_or_inconclusive') THEN 'unstable_or_inconclusive'
    WHEN bool_and(cl = 'model_beats_baseline') THEN 'model_beats_baseline' ELSE 'baseline_matches_model' END AS v FROM {name}_e WHERE comparator <> 'model' GROUP BY 1),
{name} AS MATERIALIZED (SELECT e.*, CASE WHEN comparator = 'model' THEN v ELSE cl END AS classification, n_loss, n_match, n_win, n_odd FROM {name}_e e JOIN {name}_v USING (vk))"""


RISK = ("label_drawdown_risk_20d", "actual_risk", "probability_risk")
# Feature group -> what stands for its model's probability.
RISK_GROUPS = {"technical": "model", "technical_fourier": "0.25 + 0.5 * model", "all": "1 - model"}
_THREE = ("global_fold_prevalence", "regime_fold_prevalence")


def _increment_sql(name: str, source: str) -> str:
    """Three tests per baseline and key ``vk``, from the rule."""
    names = ("model", *_THREE)
    union = " UNION ALL ".join(f"SELECT vk, '{c}' AS comparator, vk || '#{c}' AS k, {c} AS p, fold, ticker, actual FROM {source}" for c in names)
    tests = (("x.brier + 0.0025 < c.brier", "c.brier + 0.0025 < x.brier"), ("abs(x.gap) + 0.025 < abs(c.gap)", "abs(c.gap) + 0.025 < abs(x.gap)"), ("x.wf + 0.01 < c.wf", "c.wf + 0.01 < x.wf"))
    won, lost = (" + ".join(f"({t[i]})::INT" for t in tests) for i in (0, 1))
    return f""", {name}_u AS MATERIALIZED ({union}),{metrics_sql(name + '_m', name + '_u', 'k', 'actual', 'p')},
{name}_w AS (SELECT k, max(br) AS wf FROM (SELECT k, fold, round(avg((p - actual) ^ 2), 12) AS br FROM {name}_u GROUP BY 1, 2) GROUP BY 1),
{name}_n AS (SELECT k, any_value(vk) AS vk, any_value(comparator) AS comparator, count(DISTINCT ticker) AS tc, count(DISTINCT fold) AS fc FROM {name}_u GROUP BY 1),
{name}_c AS MATERIALIZED (SELECT *, rate - mp AS gap FROM {name}_m JOIN {name}_n USING (k) JOIN {name}_w USING (k)),
{name}_d AS (SELECT c.vk, c.comparator, c.brier, {won} AS won, {lost} AS lost FROM {name}_c c JOIN (SELECT * FROM {name}_c WHERE comparator = 'model') x USING (vk) WHERE c.comparator <> 'model'),
{name}_e AS (SELECT *, CASE WHEN won IS NULL OR lost IS NULL THEN 'insufficient_evidence' WHEN won >= 2 AND lost = 0 THEN 'model_beats_baseline' WHEN lost >= 2 AND won = 0 THEN 'baseline_beats_model' ELSE 'baseline_matches_model' END AS cl FROM {name}_d),
{name} AS (SELECT vk, arg_min(comparator, (round(brier, 12), comparator)) AS bb, min(brier) AS bs, CASE WHEN bool_and(cl = 'insufficient_evidence') THEN 'insufficient_evidence' WHEN bool_or(cl = 'baseline_beats_model') THEN 'baseline_beats_model'
  WHEN bool_and(cl = 'model_beats_baseline') THEN 'model_beats_baseline' ELSE 'baseline_matches_model' END AS v FROM {name}_e GROUP BY 1)"""


@query(
    "risk_feature_groups",
    sp.with_(
        rates_sql(*RISK) + ", rg AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{g}' AS vk, * REPLACE ({x} AS model) FROM rates" for g, x in RISK_GROUPS.items()) + ")" + _increment_sql("ri", "rg"),
        f"""SELECT vk AS feature_group, n AS sample_count, tc AS ticker_count, fc AS fold_count, {r('rate', 'event_prevalence')}, {r('brier', 'model_brier_score')}, {r('gap', 'model_calibration_gap')}, {r('wf', 'model_worst_fold_brier')},
  v AS classification, bb AS best_baseline, {r('bs', 'best_baseline_brier_score')}, {r('bs - brier', 'brier_improvement')} FROM ri JOIN ri_c USING (vk) WHERE comparator = 'model'""",
    ),
)
def risk_feature_groups(spark, sf):
    """Drawdown-risk models of several feature groups against fold-aware prevalences."""
    groups = F.array(*[F.struct(F.lit(g).alias("feature_group"), F.expr(x).alias("p")) for g, x in RISK_GROUPS.items()])
    rates = released(_rates(spark, sf, *RISK)).select("*", F.inline(groups)).withColumn("model", F.col("p")).drop("p")
    return shown(ch.risk_increment(rates, ["feature_group"]))


ADVERSE_LABELS = tuple(f"risk_{x}_20d" for x in ("severe_drawdown", "negative_excess", "composite_drawdown_underperform", "vol_adjusted_adverse"))
# the derived labels over the panel that has the regime
ADVERSE_PART = ADVERSE_SQL[len(sp.LABELLED):].replace("FROM labelled", "FROM panel")
_KEYED = ", rk AS MATERIALIZED (SELECT {key} AS vk, * FROM rates)"


@query(
    "adverse_label_comparison",
    sp.with_(
        sp.REGIME_SCORES + ADVERSE_PART + rates_of_labels_sql(ADVERSE_LABELS, "probability_risk", "adverse") + _KEYED.format(key="lid") + _increment_sql("ri", "rk"),
        f"""SELECT vk AS label, n AS sample_count, tc AS ticker_count, fc AS fold_count, {r('rate', 'event_prevalence')}, {r('brier', 'model_brier_score')}, {r('gap', 'model_calibration_gap')}, {r('wf', 'model_worst_fold_brier')},
  v AS classification, bb AS best_baseline, {r('bs', 'best_baseline_brier_score')}, {r('bs - brier', 'brier_improvement')} FROM ri JOIN ri_c USING (vk) WHERE comparator = 'model'""",
    ),
)
def adverse_label_comparison(spark, sf):
    """The same comparison for each adverse-outcome label."""
    panel = lb.adverse_outcomes(fx.panel(spark, sf, fx.SCORE_INPUTS))
    return shown(ch.risk_increment(released(_rates_of_labels(spark, sf, panel, ADVERSE_LABELS, "probability_risk")), ["label"]))


OPPORTUNITY_LABELS = tuple(f"label_{x}_20d" for x in ("outperform", "stronger_excess", "top_tercile_excess", "risk_adjusted_excess", "composite_opportunity"))


@query(
    "challenge_breakdown",
    sp.with_(
        sp.REGIME_SCORES + TARGET_SQL[len(sp.ALIGNED):] + ADVERSE_PART + """,
opp AS MATERIALIZED (SELECT a.ticker, a.date, a.regime, a.return_60d, a.label_outperform_20d, label_stronger_excess_20d, t.label_top_tercile_excess_20d, t.label_risk_adjusted_excess_20d, label_composite_opportunity_20d
  FROM adverse a JOIN targets t USING (ticker, date))"""
        + rates_of_labels_sql(OPPORTUNITY_LABELS, "probability_out", "opp")
        + ", sv AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT lid || '|{g}|' || {x} AS vk, * FROM rates" for g, x in (("all", "'ALL'"), ("ticker", "ticker"), ("fold", "CAST(fold AS VARCHAR)"), ("regime", "regime"))) + ")"
        + challenge_by_sql("cb", "sv"),
        "SELECT split_part(vk, '|', 1) AS label, split_part(vk, '|', 2) AS breakdown, split_part(vk, '|', 3) AS segment, "
        + ", ".join(["comparator, n AS sample_count, ticker_count, fold_count, fallback_count", *(r(x, y, 4) for x, y in _METRICS), "worst_regime, worst_fold, worst_ticker"])
        + ", classification FROM cb",
    ),
)
def challenge_breakdown(spark, sf):
    """The challenge for five labels, repeated for ALL and for every ticker, fold and regime."""
    keep = list(dict.fromkeys([*fx.RATE_INPUTS, "forward_20d_drawdown", *(c for c in OPPORTUNITY_LABELS if c not in ("label_stronger_excess_20d", "label_composite_opportunity_20d"))]))
    panel = fx.featured(spark, sf, lambda rows: lb.candidate_labels(rows, "SPY"), keep)
    panel = lb.opportunity_variants(lb.with_top_tercile(panel, keep=keep))
    rates = released(_rates_of_labels(spark, sf, panel, OPPORTUNITY_LABELS, "probability_out"))
    by = ["label", "breakdown", "segment"]
    return shown(ch.challenge(stored(ch.breakdown_metrics(rates, ch.COMPARATORS, ["label"])), by), *by, *CH_COLUMNS, digits=4)


def _edges_sql(name: str, score: str) -> str:
    """Outer rank buckets of a score per view, at most four."""
    return f"""
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY vk ORDER BY {score}, date, ticker) AS pos, count(*) OVER (PARTITION BY vk) AS n FROM fv),
{name}_b AS (SELECT *, least(4, n) AS kk, coalesce(greatest(ceil((pos - 1) * least(4, n) / nullif(n - 1, 0)) - 1, 0), 0) AS b FROM {name}_r),
{name} AS (SELECT vk, CASE WHEN min({score}) < max({score}) THEN avg(actual) FILTER (b = kk - 1) - avg(actual) FILTER (b = 0) END AS sp, CASE WHEN min({score}) < max({score}) THEN avg(forward_excess_return) FILTER (b = kk - 1) END AS top,
  CASE WHEN min({score}) < max({score}) THEN avg(forward_excess_return) FILTER (b = 0) END AS bot FROM {name}_b GROUP BY 1)"""


NAMED = ("S1", "S2")
_WILD = f"regime = '{fixed.UP_WILD}'"
FRAGILE = [
    "sample_count", "ticker_count", "fold_count", "event_prevalence", "model_roc_auc", "model_pr_auc", "model_brier_score", "model_calibration_gap", "model_bucket_spread", "inverted_roc_auc",
    "inverted_brier_score", "inverted_calibration_gap", "inverted_bucket_spread", "normal_top_bucket_forward_outcome", "normal_bottom_bucket_forward_outcome", "normal_forward_outcome_spread",
    "inverted_forward_outcome_spread", "baseline_loss_count", "baseline_match_count", "model_win_count", "unstable_count", "worst_ticker", "worst_fold", "worst_regime", "ticker_mix", "classification",
]


@query(
    "opportunity_fragility",
    sp.with_(
        rates_sql(*OPP) + ", tv AS MATERIALIZED (SELECT ticker AS vk, * FROM rates)" + challenge_by_sql("wt", "tv") + f""",
wn AS MATERIALIZED (SELECT vk AS ticker, row_number() OVER (ORDER BY n_loss DESC, coalesce(round(brier, 12), -1) DESC, vk) AS rk FROM wt WHERE comparator = 'model'),
fv AS MATERIALIZED (SELECT 'ticker|' || ticker AS vk, '' AS ex, * FROM rates UNION ALL SELECT 'fold_ticker_mix|' || CAST(fold AS VARCHAR), '', * FROM rates UNION ALL SELECT 'regime_ticker_mix|' || regime, '', * FROM rates
  UNION ALL SELECT 'high_vol_uptrend_ticker|' || ticker, '', * FROM rates WHERE {_WILD}
  UNION ALL SELECT 'high_vol_uptrend_exclude_s1|all_remaining', 'S1', * FROM rates WHERE {_WILD} AND ticker <> 'S1' UNION ALL SELECT 'high_vol_uptrend_exclude_s1_s2|all_remaining', 'S1,S2', * FROM rates WHERE {_WILD} AND ticker NOT IN ('S1', 'S2')
  UNION ALL SELECT 'exclude_worst_ticker|all_remaining', (SELECT ticker FROM wn WHERE rk = 1), * FROM rates WHERE ticker NOT IN (SELECT ticker FROM wn WHERE rk = 1)
  UNION ALL SELECT 'exclude_worst_two_tickers|all_remaining', (SELECT string_agg(ticker, ',' ORDER BY rk) FROM wn WHERE rk <= 2), * FROM rates WHERE ticker NOT IN (SELECT ticker FROM wn WHERE rk <= 2))"""
        + challenge_by_sql("fg", "fv") + ", fi AS (SELECT *, 1 - model AS q FROM fv)," + metrics_sql("im", "fi", "vk", "actual", "q") + "," + _edges_sql("en", "model") + "," + _edges_sql("ei", "(1 - model)") + """,
fx AS (SELECT vk, max(ex) AS ex, string_agg(ticker || ':' || n, ';' ORDER BY ticker) AS mix FROM (SELECT vk, ex, ticker, count(*) AS n FROM fv GROUP BY 1, 2, 3) GROUP BY 1)""",
        f"""SELECT split_part(g.vk, '|', 1) AS view, split_part(g.vk, '|', 2) AS segment, ex AS excluded_tickers, g.n AS sample_count, ticker_count, fold_count, {r('g.rate', 'event_prevalence')}, {r('g.auc', 'model_roc_auc')},
  {r('g.ap', 'model_pr_auc')}, {r('g.brier', 'model_brier_score')}, {r('g.gap', 'model_calibration_gap')}, {r('en.sp', 'model_bucket_spread')}, {r('im.auc', 'inverted_roc_auc')}, {r('im.brier', 'inverted_brier_score')},
  {r('im.rate - im.mp', 'inverted_calibration_gap')}, {r('ei.sp', 'inverted_bucket_spread')}, {r('en.top', 'normal_top_bucket_forward_outcome')}, {r('en.bot', 'normal_bottom_bucket_forward_outcome')},
  {r('en.top - en.bot', 'normal_forward_outcome_spread')}, {r('ei.top - ei.bot', 'inverted_forward_outcome_spread')}, n_loss AS baseline_loss_count, n_match AS baseline_match_count, n_win AS model_win_count, n_odd AS unstable_count,
  worst_ticker, worst_fold, worst_regime, mix AS ticker_mix, classification FROM fg g JOIN im USING (vk) JOIN en USING (vk) JOIN ei USING (vk) JOIN fx USING (vk) WHERE comparator = 'model'""",
    ),
)
def opportunity_fragility(spark, sf):
    rates = stored(_rates(spark, sf, *OPP))
    return shown(ch.fragility(rates, NAMED), "view", "segment", "excluded_tickers", *FRAGILE)
