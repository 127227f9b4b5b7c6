import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontam import brute
from tests.llm.test_tokens import WORDS, check_packing, library
from tidemill.llm import toxic_cnn

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest documents, an extra column, and rows with nulls, no words, repeats and a very long text."""
    real = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("own")).withColumn("row", F.lit(1))
    odd = [(9001, None, "en"), (9002, "", None), (9003, "123 456", "fr"), (9004, "the one and the other of them were there", "en"), (9004, "the one and the other of them were there", "en"), (None, "and the rest of it was there for them", None), (9005, "the word was there and " * 8000, "en")]
    more = spark.createDataFrame(odd, "doc_id bigint, text string, lang string").selectExpr("*", "cast(null AS string) AS source", "cast(null AS bigint) AS n_chars", "'own' AS score", "1 AS row")
    return real.unionByName(more).cache()


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_language_keeps_what_has_letters(spark, docs):
    out = corpus_pipeline.language(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(set(ids(docs)) - set(ids(out)), key=str) == [9001, 9002, 9003]
    assert corpus_pipeline.language(spark, docs.limit(0), SF).count() == 0


def test_toxicity_keeps_what_op4_calls_clean(spark, docs):
    out = corpus_pipeline.toxicity(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = toxic_cnn.predicted(docs, labels).where("predicted = 0")
    assert out.columns == docs.columns and ids(out) == ids(want)
    assert corpus_pipeline.toxicity(spark, docs.limit(0), SF).count() == 0


def test_decontaminate_matches_brute_force(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in brute([(r.doc_id, r.text) for r in docs.collect()], items) if r[5]}
    out = corpus_pipeline.decontaminate(spark, docs, SF)
    assert out.columns == docs.columns and ids(out) == [d for d in ids(docs) if d not in bad]
    assert corpus_pipeline.decontaminate(spark, docs.limit(0), SF).count() == 0


def test_packing_and_the_whole(spark, docs):
    rows = [tuple(r) for r in corpus_pipeline.pack(spark, docs, SF).collect()]
    check_packing(rows, library(WORDS), [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and whole.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near-dedup", "decontaminate", "packing"]
