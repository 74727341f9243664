"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import (
    bpe,
    divergence,
    exact_dedup,
    language,
    lm,
    near_dedup,
    packing,
    periodic_runs,
    search,
    sentencepieces,
    token_counts,
    token_files,
    toxicity,
)
from tickerloom.llm.common import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    "op1_exact_dedup",
    r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size,
                      sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER best AS kept, text_sha256
    FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)
    """,
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_lm_score")
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (remainder("doc_id", 10) == 0).alias("held_out"))
    return lm.score(docs, lm.fit(docs.filter("NOT held_out")), ["doc_id", "held_out"])


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (remainder("doc_id", 4) == 2).alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder("doc_id", 4) != 2)
    return toxicity.score(docs, toxicity.fit(docs.filter("NOT held_out"), labels), ["doc_id", "held_out"])


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.checks(token_files.write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (remainder("doc_id", 4) == 2).alias("held_out"))
    model = language.fit(docs.filter("NOT held_out"))
    return language.predict(docs, model, keep=["doc_id", "held_out"])


@query("op8_bm25_search")
def op8_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return search.search(docs, docs.filter("doc_id % 50 = 0"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query("op10_near_dedup")
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir), words=3, percent=85)


WORD = r"[^\x20\x09-\x0D]+"


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id, text: where crc32(doc_id) mod 10 is 0, the words from a on repeat those of one period."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    a = F.expr("g % n")
    period = F.expr("1 + (n - g % n) div (3 + g % 8)")
    rows = rows.select("doc_id", "text", "words", "n", F.when(F.col("n") > 0, a).alias("a"), F.when(F.col("n") > 0, period).alias("p"))

    def source(i):
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")

    again = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", source(i)))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(made_periodic(documents(spark, sf_dir)), least=6, times=4)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    marked = found.withColumn("longest", longest)
    return marked.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("(1000 * longest.length) div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op13_source_divergence",
    r"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
         w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
         l AS (SELECT lang, term, count(*) AS uses FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 3),
         lt AS (SELECT lang, sum(uses) AS n, count(*) AS v FROM l GROUP BY lang),
         c AS (SELECT w.lang, source, w.term, count(*) AS uses FROM w JOIN l USING (lang, term) GROUP BY ALL),
         g AS (SELECT lang, source, coalesce(sum(uses), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
         p AS (SELECT g.lang, g.source, l.term, coalesce(c.uses, 0) AS uses, 1 + 1000000000::HUGEINT * (coalesce(c.uses, 0) + 1) // (g.n + lt.v)::HUGEINT AS p,
                      1 + 1000000000::HUGEINT * (l.uses + 1) // (lt.n + lt.v)::HUGEINT AS q
               FROM g JOIN l USING (lang) JOIN lt USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
         pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
         both_parts AS (
           SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(pair.value, 0)::BIGINT AS value
           FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
                LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source
           UNION ALL
           SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE uses > 0 AND p > q)
    SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM both_parts QUALIFY part = 'pair' OR rank <= 200
    """,
)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir), least=3, most_terms=200)
