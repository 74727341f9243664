"""Exact deduplication with a heavy-hitter split.  DataFrame functions only.

1. One pass over the texts leaves a narrow table: row, id, code points, SHA-256
   of the normalised text.
2. Misra-Gries counters (``freqItems``) name every digest that more than
   ``support`` of all rows carry; at most ``1/support`` digests, however large
   the table.  An exact, map-side combined count verifies them and finds their
   winners.
3. The verified winners (at most ``1/support`` rows) are broadcast: rows of
   frequent digests are settled in the map stage and never shuffled.
4. All other digests have few rows each and use an ordinary aggregate and join.

Defined cases: a null text equals the empty text; texts of white space only are
equal to it.  Of equal texts the row with the most code points stays, then the
smallest id (a null id comes last), then the first row read, so of repeated rows
exactly one is kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import bounded_broadcast, free_names
from tickerloom.plans.storage import settle

WHITE = r"[\x20\x09-\x0D]"
SUPPORT = 0.002
#: Repeated ids that are broadcast.
FEW_IDS = 100_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, size (code points of the original), text_sha256 (of the normalised text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.length(text).alias("size"),
        F.sha2(F.regexp_replace(text, WHITE, "").cast("binary"), 256).alias("text_sha256"),
    )


def _winner():
    order = F.struct(-F.col("size"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    return [F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size")]


def heavy_winners(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Winner and exact count of every digest on more than ``support`` of all rows."""
    named = rows.stat.freqItems(["text_sha256"], support)
    named = named.select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    exact = rows.join(F.broadcast(named), "text_sha256").groupBy("text_sha256").agg(*_winner())
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))
    return exact.join(total).filter(F.col("group_size") > F.lit(support) * F.col("total")).drop("total")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    rows = settle(digests(docs, id_col, text_col))
    heavy = settle(heavy_winners(rows, support))
    hot = rows.join(F.broadcast(heavy), "text_sha256")
    rest = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    cold = rest.join(rest.groupBy("text_sha256").agg(*_winner()), "text_sha256")
    return hot.unionByName(cold).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    A row that stays is found again by its id.  Rows of an id that occurs several
    times are found by id and digest, so neither a repeated nor a null id gathers
    in one task; of repeated rows the longest original stays.
    """
    marked = settle(exact_dedup(docs, id_col, text_col, support))
    per_id = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("stay"))
    per_id = settle(per_id.filter("stay > 0"))
    key, digest, size, one = free_names(docs, "kept_id", "kept_digest", "kept_size", "kept_row")
    single = per_id.filter("rows = 1").select(F.col("doc_id").alias(key))
    out = docs.join(single, F.col(id_col).eqNullSafe(F.col(key)), "left_semi")
    several = per_id.filter("rows > 1").select(F.col("doc_id").alias(key))
    if several.isEmpty():
        return out
    several = bounded_broadcast(several, FEW_IDS)
    stay = marked.filter("kept").select("doc_id", F.col("text_sha256").alias(digest))
    stay = stay.join(several, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi").withColumnRenamed("doc_id", key)
    text = F.coalesce(F.col(text_col), F.lit(""))
    again = docs.join(several, F.col(id_col).eqNullSafe(F.col(key)), "left_semi").select(
        F.struct("*").alias(one), F.sha2(F.regexp_replace(text, WHITE, "").cast("binary"), 256).alias(digest), (-F.length(text)).alias(size), F.col(id_col).alias(key)
    )
    other = stay.select(F.col(key).alias("id"), F.col(digest).alias("digest"))
    again = again.join(other, F.col(key).eqNullSafe(F.col("id")) & (F.col(digest) == F.col("digest")), "left_semi")
    first = again.groupBy(key, digest).agg(F.min_by(one, size).alias(one))
    return out.unionByName(first.select(f"{one}.*"))
