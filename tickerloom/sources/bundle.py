"""Run bundles: named result tables under one folder, and their comparison."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom import fixed



def safe_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "table"


def write_bundle(spark: SparkSession, tables: Mapping[str, DataFrame | None], root: str, run_id: str) -> DataFrame:
    """Write every non-empty table as ``root/<name>/run_id=<id>`` and a manifest."""
    manifest = []
    for name, table in tables.items():
        stem = safe_name(name)
        if table is None:
            manifest.append((run_id, stem, 0, "", "missing"))
            continue
        path = f"{root}/{stem}/run_id={run_id}"
        table.write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path).count()
        manifest.append((run_id, stem, rows, ",".join(table.columns), "written" if rows else "empty"))
    out = spark.createDataFrame(manifest, "run_id string, table string, rows long, columns string, status string")
    out.write.mode("overwrite").parquet(f"{root}/manifest/run_id={run_id}")
    return out


def read_table(spark: SparkSession, root: str, name: str, schema: str, run_id: str | None = None) -> DataFrame:
    """A bundle table of one run (default: the latest), typed-empty when absent."""
    try:
        table = spark.read.parquet(f"{root}/{safe_name(name)}")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise
    if run_id is not None:
        return table.filter(F.col("run_id") == run_id)
    latest = table.agg(F.max("run_id").alias("run_id"))
    return table.join(F.broadcast(latest), "run_id")


def metric_rows(targets: DataFrame) -> DataFrame:
    """``(metric, value)`` from a one-row-per-target table of numeric columns."""
    names = [c for c, t in targets.dtypes if t in ("double", "bigint", "int") and c != "target_id"]
    entries = F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("value")) for c in names])
    return targets.select("target_id", F.inline(entries)).select(F.concat_ws(".", "target_id", "m").alias("metric"), "value").filter("value IS NOT NULL")


def compare_runs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Full outer pairing of two ``(metric, value)`` tables with a per-metric read.

    The metric's name decides its rule: scores (``auc``, ``spread``) and losses
    (``brier``) make a run worse or improved; a negative candidate spread or more
    inversions make it worse; a larger calibration gap, more regime-sensitive
    targets, or a lower ``consistency`` or ``quality`` make it mixed at best.
    Drawdown-risk losses can only make it worse, and drawdown-risk scores decide nothing.
    """
    b, c = baseline.select("metric", F.col("value").alias("baseline")), candidate.select("metric", F.col("value").alias("candidate"))
    out = b.join(c, "metric", "full_outer").withColumn("delta", F.col("candidate") - F.col("baseline"))
    name, delta = F.lower("metric"), F.col("delta")
    limit = {k: F.lit(v) for k, v in fixed.RUN_TOLERANCE.items()}
    score = F.when(name.contains("auc") & ~name.contains("drawdown"), limit["auc"]).when(name.contains("spread"), limit["spread"])
    read = (
        F.when(name.contains("spread") & (F.col("candidate") < 0), "worse")
        .when(delta.isNull(), "not compared")
        .when(score.isNotNull(), F.when(delta < -score, "worse").when(delta > score, "improved").otherwise("same"))
        .when(name.contains("brier"), F.when(delta > limit["brier"], "worse").when((delta < -limit["brier"]) & ~name.contains("drawdown"), "improved").otherwise("same"))
        .when(name.contains("inversion"), F.when(delta > 0, "worse").otherwise("same"))
        .when(name.contains("gap"), F.when(delta > limit["gap"], "mixed").otherwise("same"))
        .when(name.contains("sensitive"), F.when(delta > 0, "mixed").otherwise("same"))
        .when(name.contains("consistency") | name.contains("quality"), F.when(delta < 0, "mixed").otherwise("same"))
        .otherwise("not compared")
    )
    return out.withColumn("read", read)


RECOMMENDATION = {
    "improved": "commit_candidate",
    "mixed": "manual_review_required",
    "worse": "do_not_commit_algorithm_change",
    "insufficient_evidence": "insufficient_evidence",
}


def verdict(compared: DataFrame) -> DataFrame:
    """One row: any worse metric decides, then any mixed one, then any improved one."""
    one = compared.agg(*[F.count_if(F.col("read") == r).alias(r) for r in ("improved", "worse", "mixed", "same")])
    status = F.when(F.col("worse") > 0, "worse").when(F.col("mixed") > 0, "mixed").when(F.col("improved") > 0, "improved").otherwise("insufficient_evidence")
    advice = F.create_map(*[F.lit(x) for kv in RECOMMENDATION.items() for x in kv])
    return one.withColumn("verdict", status).withColumn("recommendation", advice[F.col("verdict")])
