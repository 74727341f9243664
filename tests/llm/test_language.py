from pyspark.sql import functions as F

from tickerloom.llm import language
from tickerloom.llm.queries import QUERIES


def test_grams_of_a_short_text():
    bucket, owner, counts = language.grams(["ab", "", "1 2"])
    assert counts.tolist() == [2, 0, 0] and set(owner.tolist()) == {0}
    assert len(bucket) == 2 + 3 + 2  # a b, _a ab b_, _ab ab_


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op7_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    held = out.filter("held_out AND lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert held[0] > 0.97 and held[1] > 200
    assert out.filter("(lang_pred = 'und') <> (text IS NULL OR NOT text RLIKE '\\\\p{L}')").count() == 0


def test_odd_rows_and_empty_tables(odd, empty):
    model = language.fit(odd)
    out = {(r.doc_id, r.text): r for r in language.predict(odd, model).collect()}
    assert len(out) == 16
    assert {k[0] for k, r in out.items() if r.lang_pred == "und"} == {4, 5, 6, 14}
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language.predict(empty, model).count() == 0
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}
