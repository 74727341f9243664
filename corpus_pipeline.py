"""Corpus pipeline over the documents table: STAGES, run(), ORACLE_SQL.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.  Rows with null texts or ids pass through by the
rules of each operator: a null text is empty, has no language and so goes at the
language stage.  Repeated rows and ids are single rows to the classifiers and equal
texts to the deduplication.  Extra columns are kept, whatever their names.  An empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import exact_dedup, language, near_dedup, packing, toxicity
from tickerloom.llm.common import free_names, written

#: Posterior that a predicted language needs.
LEAST_POSTERIOR = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, fitted on all labelled documents, calls toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    into = "toxicity_"
    while any(c.lower().startswith(into) for c in docs.columns):
        into += "_"
    marked = toxicity.score(docs, model, docs.columns, into=into)
    return marked.filter(f"{into}predicted = 0").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language: without a letter, or where the predicted language
    is less likely than all others together.  If nothing could be learned, those without a letter."""
    model = language.fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    name, posterior = free_names(docs, "predicted_language", "posterior")
    marked = language.predict(docs, model, into=(name, posterior))
    recognised = (F.col(name) != language.UNDECIDED) & (F.col(posterior) >= LEAST_POSTERIOR)
    return marked.filter(recognised).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by shingles of five words and a similarity of 0.8 or more."""
    return near_dedup.drop_near_copies(docs, words=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all remaining documents into sequences of 1024 tokens; one row per piece."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: The classifiers and tokenizers are not expressible in SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
