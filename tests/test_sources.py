"""Headers, duplicates, coercion, bundles and text parsing."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from tickerloom.functions.text import symbol_list, weight_pairs
from tickerloom.sources import bars as br
from tickerloom.sources import bundle as bd


def test_header_spellings():
    assert [br.canonical_field(h) for h in ("Adj Close.1", "adjclose", "ADJ_CLOSE", " Volume ", "foo")] == ["adj_close", "adj_close", "adj_close", "volume", None]


def test_last_column_and_last_row_win(spark):
    raw = spark.createDataFrame(
        [("a", "2024-01-02", "1", "1", "1", "1", "9", "5", "10"), ("a", "2024-01-02", "2", "2", "2", "2", "9", "6", "x"), ("a", "2024-01-03", "3", "3", "3", "3", "9", None, "1"), ("a", "bad", "3", "3", "3", "3", "9", "3", "1")],
        ["ticker", "Date", "Open", "High", "Low", "Close", "Adj Close", "Adj Close.1", "Volume"],
    ).coalesce(1)
    got = br.normalize(raw).collect()
    assert len(got) == 1
    assert (got[0].ticker, got[0].date, got[0].adj_close, got[0].volume) == ("A", dt.date(2024, 1, 2), 6.0, None)


def test_missing_column_raises_before_any_job(spark):
    with pytest.raises(ValueError):
        br.normalize(spark.createDataFrame([("2024-01-01", 1.0)], "Date string, Open double"))


def test_csv_and_store_round_trip(spark):
    root = tempfile.mkdtemp(prefix="spark-src-", dir="/tmp")
    rows = [("2024-01-02", 1.0, 2.0, 0.5, 1.5, 1.5, 100.0), ("2024-01-03", 1.0, 2.0, 0.5, 1.6, 1.6, 100.0)]
    df = spark.createDataFrame(rows, ["Date", "Open", "High", "Low", "Close", "Adj Close", "Volume"])
    df.coalesce(1).toPandas().to_csv(f"{root}/abc.csv", index=False)
    bars = br.read_csv(spark, f"{root}/abc.csv", end="2024-01-02")
    assert [(r.ticker, str(r.date)) for r in bars.collect()] == [("ABC", "2024-01-02")]
    br.write_bars(bars, f"{root}/store")
    ask = spark.createDataFrame([("ABC", dt.date(2024, 1, 2), dt.date(2024, 1, 2)), ("ABC", dt.date(2024, 1, 1), None), ("ZZZ", None, None)], "ticker string, start date, end date")
    short = br.coverage(spark.read.parquet(f"{root}/store"), ask)
    assert sorted((r.ticker, r.start) for r in short.collect() if r.start) == [("ABC", dt.date(2024, 1, 1))]
    assert short.count() == 2


def test_a_heavy_bucket_is_split(spark):
    """One bucket holds all rows, yet files are bounded and every row comes back."""
    root = tempfile.mkdtemp(prefix="spark-src-", dir="/tmp")
    bars = spark.range(3000).selectExpr("'ABC' AS ticker", "date_add(DATE'2015-01-01', CAST(id AS INT)) AS date", "CAST(id AS double) AS close")
    br.write_bars(bars, f"{root}/store", buckets=1, file_rows=700)
    back = spark.read.parquet(f"{root}/store")
    sizes = [r.n for r in back.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 700
    assert back.select("ticker", "date", "close").exceptAll(bars).count() == 0


def test_events_status(spark):
    root = tempfile.mkdtemp(prefix="spark-src-", dir="/tmp")
    assert br.read_events(spark, f"{root}/none.csv")[1] == "missing"
    with open(f"{root}/bad.csv", "w") as f:
        f.write("symbol,date\nA,2024-01-01\n")
    assert br.read_events(spark, f"{root}/bad.csv")[1] == "invalid_schema"
    with open(f"{root}/ok.csv", "w") as f:
        f.write("Ticker,Earnings_Date,report_timing\n a ,2024-01-01,AFTER_CLOSE\nA,2024-01-01,later\n,2024-01-01,\nB,nope,\n")
    events, status = br.read_events(spark, f"{root}/ok.csv")
    assert status == "loaded"
    assert [(r.ticker, r.report_timing) for r in events.collect()] == [("A", "")]


def test_csv_columns_are_found_by_name_in_every_file(spark):
    root = tempfile.mkdtemp(prefix="spark-src-", dir="/tmp")
    with open(f"{root}/aa.csv", "w") as f:
        f.write("Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-02,1,2,0.5,1.5,1.4,100\n")
    with open(f"{root}/bb.csv", "w") as f:
        f.write("Date,Adj Close,Close,High,Low,Open,Volume\n2024-01-02,1.4,1.5,2,0.5,1,100\n2024-01-03,2.4,2.5,3,1.5,2,200\n")
    with open(f"{root}/cc.csv", "w") as f:
        f.write("Date,Open,High,Low,Close,Adj Close,Adj Close,Volume,Adj Close.1\n2024-01-02,1,2,0.5,1.5,8,9,100,1.4\n")
    with open(f"{root}/dd.csv", "w") as f:
        f.write("Date,Open,High,Low,Close,Adj Close,Adj Close,Volume\n2024-01-02,1,2,0.5,1.5,8,1.4,100\n")
    got = {(r.ticker, str(r.date)): tuple(r)[2:] for r in br.read_csv(spark, root).select("ticker", "date", "open", "high", "low", "close", "adj_close", "volume").collect()}
    one = (1.0, 2.0, 0.5, 1.5, 1.4, 100.0)
    assert got == {("AA", "2024-01-02"): one, ("BB", "2024-01-02"): one, ("BB", "2024-01-03"): (2.0, 3.0, 1.5, 2.5, 2.4, 200.0), ("CC", "2024-01-02"): one, ("DD", "2024-01-02"): one}


def test_bundle_and_comparison(spark):
    root = tempfile.mkdtemp(prefix="spark-src-", dir="/tmp")
    for run, auc in (("1", 0.55), ("2", 0.60)):
        table = spark.createDataFrame([("t", auc, 0.2)], "target_id string, roc_auc double, brier_score double")
        manifest = bd.write_bundle(spark, {"Target Table": table, "gone": None}, root, run)
        assert {r.table: r.status for r in manifest.collect()} == {"target_table": "written", "gone": "missing"}
    schema = "target_id string, roc_auc double, brier_score double"
    assert bd.read_table(spark, root, "Target Table", schema).first().roc_auc == 0.60
    assert bd.read_table(spark, root, "nothing", schema).count() == 0
    runs = [bd.metric_rows(bd.read_table(spark, root, "Target Table", schema, r).select("target_id", "roc_auc", "brier_score")) for r in "12"]
    compared = bd.compare_runs(*runs)
    assert {r.metric: r.read for r in compared.collect()} == {"t.roc_auc": "improved", "t.brier_score": "same"}
    assert bd.verdict(compared).first().verdict == "improved"


@pytest.mark.parametrize(
    "changes,status,advice",
    [
        ({"outperformance_roc_auc": (0.55, 0.60)}, "improved", "commit_candidate"),
        ({"outperformance_roc_auc": (0.55, 0.60), "outperformance_brier_score": (0.20, 0.23)}, "worse", "do_not_commit_algorithm_change"),
        ({"outperformance_roc_auc": (0.55, 0.60), "calibration_gap": (0.01, 0.05)}, "mixed", "manual_review_required"),
        ({"bucket_spread": (-0.02, -0.01)}, "worse", "do_not_commit_algorithm_change"),
        ({"outperformance_roc_auc": (0.55, 0.553)}, "insufficient_evidence", "insufficient_evidence"),
        ({"outperformance_roc_auc": (0.55, None)}, "insufficient_evidence", "insufficient_evidence"),
        ({"outperformance_pr_auc": (0.5, 0.6), "regime_inversion_count": (0.0, 1.0)}, "worse", "do_not_commit_algorithm_change"),
        ({"outperformance_pr_auc": (0.5, 0.6), "regime_sensitive_count": (0.0, 1.0)}, "mixed", "manual_review_required"),
        ({"bucket_spread": (0.01, 0.02), "feature_group_consistency": (2.0, 1.0)}, "mixed", "manual_review_required"),
        ({"drawdown_risk_brier_score": (0.30, 0.20)}, "insufficient_evidence", "insufficient_evidence"),
    ],
)
def test_run_verdicts(spark, changes, status, advice):
    before, after = (
        spark.createDataFrame([(m, v[k]) for m, v in changes.items()], "metric string, value double").filter("value IS NOT NULL") for k in (0, 1)
    )
    row = bd.verdict(bd.compare_runs(before, after)).first()
    assert (row.verdict, row.recommendation) == (status, advice)


def test_ablation_conclusions(spark):
    from tickerloom.operators.models import ablation_read

    rows = [("a", 0.60, 0.50, None), ("b", 0.60, 0.50, -0.1), ("c", 0.45, 0.50, -0.1), ("d", 0.51, 0.30, None), ("e", 0.45, 0.50, None)]
    out = {r.k: r.conclusion for r in ablation_read(spark.createDataFrame(rows, "k string, roc_auc double, f1 double, quintile_spread double")).collect()}
    assert out == {"a": "adds value", "b": "mixed", "c": "likely overfit", "d": "no clear value", "e": "mixed"}


def test_prevalence_rule_without_evidence(spark):
    from tickerloom.operators.challenge import prevalence_rule

    rows = [("model", 0.20, 0.01, 0.22), ("base", 0.25, None, 0.30)]
    out = prevalence_rule(spark.createDataFrame(rows, "comparator string, brier_score double, calibration_gap double, worst_fold_brier double"))
    assert {r.comparator: r.classification for r in out.collect()} == {"model": "insufficient_evidence", "base": "insufficient_evidence"}


def test_stop_rule_with_unknown_values(spark):
    from tickerloom.operators.targets import evidence_rollup, stop_rule

    base = ("outperform_20d", 0.55, 0.4, 0.20, 0.02, 0.01, 0, 5, 900, 0.4, "Healthy", "Mixed", "Insufficient data", 0.01)
    rows = [
        base,
        ("good_20d", 0.57, 0.4, 0.20, 0.03, 0.01, 0, 5, 900, 0.4, "Healthy", "Mixed", "Insufficient data", 0.01),
        ("unknown_20d", 0.57, 0.4, 0.20, None, 0.01, 0, 5, 900, 0.4, "Healthy", "Mixed", "Insufficient data", 0.01),
        ("far_60d", 0.50, 0.4, 0.24, 0.01, 0.01, 0, 5, 900, 0.4, "Healthy", "Mixed", "Insufficient data", 0.01),
        ("rare_20d", 0.40, 0.4, 0.20, -0.01, 0.09, 1, 5, 900, 0.1, "Skewed", "Weak", "Insufficient data", -0.2),
    ]
    schema = (
        "target_id string, roc_auc double, pr_auc double, brier_score double, bucket_spread double, calibration_gap double, regime_inversion_count long, folds long, "
        "prediction_count long, positive_rate double, class_balance_status string, overall_target_quality string, feature_group_consistency string, worst_regime_bucket_spread double"
    )
    out = {r.target_id: (r.stop_rule_result, r.likely_failure_cause, r.recommended_decision) for r in stop_rule(spark.createDataFrame(rows, schema)).collect()}
    assert out == {
        "outperform_20d": ("baseline", "current baseline", "Continue"),
        "good_20d": ("pass", "evidence clears stop rule", "Continue"),
        "unknown_20d": ("fail", "missing evidence fields", "Needs more data"),
        "far_60d": ("fail", "horizon mismatch / thin folds; weak feature separation", "Needs more data"),
        "rare_20d": (
            "fail", "target design / class imbalance; target noise / calibration; regime inversion; weak feature separation", "Kill",
        ),
    }
    areas = spark.createDataFrame([("a", "Mixed"), ("a", "useful"), ("b", "odd"), ("b", "odd"), ("b", "own")], "area string, classification string")
    rolled = {r.area: tuple(r)[1:] for r in evidence_rollup(areas, ["a", "b", "c"]).collect()}
    assert rolled == {
        "a": ("mixed", "mixed", "not_ready"), "b": ("odd", "watch", "not_ready"), "c": ("unavailable", "unavailable", "unavailable"),
        "Overall production readiness": ("not_ready", "blocking", "not_ready"),
    }


def test_text_parsing(spark):
    one = spark.createDataFrame([(" nvda, TSM\nbrk/b,,nvda",)], "raw string")
    assert one.select(symbol_list(F.col("raw"))).first()[0] == ["NVDA", "TSM", "BRK-B"]
    pairs = weight_pairs(spark.createDataFrame([("NVDA 0.12, tsm=0.08; bad",)], "raw string"), "raw").collect()
    assert [(p.ticker, p.weight, p.error) for p in pairs] == [("NVDA", 0.12, None), ("TSM", 0.08, None), ("", None, "not a pair")]
