"""Shared pieces: shared-folder tables, text slices of Arrow batches, id splits."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.plans.storage import checkpoint_dir

SLICE_BYTES = 4 << 20


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """For each stem a name that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the checkpoint folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Later reads prune columns and never repeat the work, and losing an executor
    costs nothing but a re-read.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder, usable inside tasks."""
    local = re.sub(r"^file:/+", "/", uri)
    if "://" not in local:
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(uri)


def parquet_files(path: str) -> tuple[fs.FileSystem, list[str]]:
    """Parquet files of a shared folder in order, for reading inside tasks; none if it isn't there."""
    files, where = store(path)
    found = files.get_file_info(fs.FileSelector(where, allow_not_found=True))
    return files, sorted(f.path for f in found if f.path.endswith(".parquet"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes of text (one row at least).

    After the last one, memory that the task no longer uses goes back to the system:
    workers live on, and other tasks and the executor need it.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """Texts of a batch with null as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").to_pylist()


def release() -> None:
    """Give memory that this worker no longer uses back to the system: Arrow's pool, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of consecutive runs."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return ends - lengths, ends


def picked(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every run, one run after the other."""
    _, ends = spans(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (shuffled)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
