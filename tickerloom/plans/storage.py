"""Durable lineage cuts.

Results that are read more than once and must be identical on every read (rank
inputs, model inputs, iterative joins) are written once to the shared checkpoint
folder.  A lost executor then re-reads files instead of re-running a
floating-point aggregation whose last bits could differ.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a scratch folder only in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and continue from the files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``settle`` for tables with as many rows as the panel: compressed columns instead of whole rows.

    Repeated names, dates and labels take next to no room, and a later pass reads only
    the columns that it needs.  Partitions are not kept: what depends on them must be a column.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    for tables in _PASSING:
        tables.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> DataFrame:
    """``stored``, and shuffle files that nothing refers to any more are deleted, as those that ``df`` was made from."""
    out = stored(df)
    collect_garbage(df.sparkSession)
    return out


def collect_garbage(spark: SparkSession) -> None:
    """Spark drops shuffle files of plans that were collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Tables stored since each ``passing`` began.
_PASSING: list[list[str]] = []


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside are deleted at the end, and shuffle files that nothing refers to any more.

    What goes on from here must have been settled inside.
    """
    tables: list[str] = []
    _PASSING.append(tables)
    try:
        yield
    finally:
        _PASSING[:] = [t for t in _PASSING if t is not tables]
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in tables:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        collect_garbage(spark)
