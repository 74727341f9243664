import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_exact_dedup import brute as exact_brute
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.01"


def test_stages_follow_one_another(spark):
    """Each stage against a brute-force version on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "exact_dedup", "near_dedup", "packing"]
    kept, columns = [docs], docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], SF).cache()
        assert out.columns == columns
        kept.append(out)
    rows = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in kept]
    assert all(len(b) == d.count() for b, d in zip(rows, kept))
    for before, after in zip(rows, rows[1:]):
        assert after.items() <= before.items()
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    gone = rows[0].keys() - rows[1].keys()
    assert gone and len(gone & toxic) / len(gone & {r.doc_id for r in labels.collect()}) > 0.5
    assert rows[1].keys() - rows[2].keys() == {k for k, t in rows[1].items() if not any(c.isalpha() for c in t or "")}
    assert rows[3].keys() == {d for d, _, _, stays, _ in exact_brute(list(rows[2].items())) if stays}
    assert rows[4].keys() == {d for d, _, _, stays in near_brute(list(rows[3].items()), 5, 80) if stays}
    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: [[*own.encode(t or "", add_special_tokens=False).ids, 0]] for k, t in rows[4].items()}
    assert check_packing(corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect(), ids) == 0


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_odd_and_empty_tables_pass_through(spark, odd, empty, tmp_path, kind):
    rows = (odd if kind == "odd" else empty).withColumn("_toxicity_predicted", F.lit("extra")) if kind == "odd" else empty
    spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    if kind == "odd":
        rows = rows.drop("_toxicity_predicted")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() == 0 if kind == "empty" else out.count() > 0


def test_language_stage_keeps_documents_when_no_row_has_a_language(spark):
    rows = [(1, "the house and the garden", None), (2, "das Haus", None), (3, "12 34 !!", None), (4, None, None), (5, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, SF).collect()} == {1, 2}


CLASHING = ("_id", "_now", "_size", "_digest", "_one", "_language", "_language_score", "_toxicity_predicted", "toxicity_predicted", "kept_id", "kept_row", "predicted_language", "Posterior", "row", "digest", "id")


def test_columns_of_any_name_are_kept(spark, odd, tmp_path):
    """Every stage but the last returns the rows it keeps as they came, also those of repeated and null ids."""
    third = [(None if i % 3 else i, f"text of document {i % 200} with some words and {i % 7} more", "en") for i in range(600)]
    rows = odd.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(third, "doc_id bigint, text string, lang string"))
    rows = rows.withColumns({c: F.concat(F.lit(c), F.coalesce("text", F.lit("-"))) for c in CLASHING})
    spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path)).cache()
        assert out.columns == rows.columns
        assert out.exceptAll(rows).count() == 0 and out.count() > 0


def test_repeated_and_null_ids_keep_one_row_of_each_text(spark):
    from tickerloom.llm import exact_dedup

    rows = [(None if i % 2 else 7, "a b" if i % 5 == 0 else f"text {i % 40}" + " " * (i % 3), i) for i in range(400)] + [(1, "alone", -1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _now int").repartition(5)
    kept = exact_dedup.drop_copies(docs).collect()
    best = {}
    for doc_id, text, _ in rows:
        order = (-len(text), doc_id is None, doc_id or 0)
        digest = text.replace(" ", "")
        best[digest] = min(best.get(digest, order), order)
    assert sorted((r.text.replace(" ", ""), -len(r.text), r.doc_id is None) for r in kept) == sorted((d, n, null) for d, (n, null, _) in best.items())


def test_language_stage_goes_by_the_posterior(spark, monkeypatch):
    en, de = "the house and the garden of the old man", "das alte Haus und der Garten von dem Mann"
    docs = spark.createDataFrame([(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(40)] + [(100, "zz", None)], "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, SF).collect()} >= set(range(40))
    monkeypatch.setattr(corpus_pipeline, "LEAST_POSTERIOR", 0.9)
    left = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, SF).collect()}
    assert left == set(range(40))
