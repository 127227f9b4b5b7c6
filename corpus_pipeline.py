"""A corpus pipeline: STAGES in order, each written and read again; run() applies them to documents.

language    documents that are und, or whose language is unsure, go
toxicity    documents called toxic go
near-dedup  of each group of linked near copies (SimHash, verified; 5-word shingles, Jaccard 0.8 or more), one row stays: the smallest doc_id
decontaminate  documents that hold benchmark windows go
packing     the rest is cut and packed: one row per piece

The columns of documents pass through all stages but the last. Models are learnt from what the stage gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontam, lang_gru, near_copies, packing, toxic_cnn
from tidemill.llm.shared import fresh_path, staged
from tidemill.llm.token_ids import vocabulary

#: A document whose language is less sure than this is rejected.
LANGUAGE_SURE = 0.4


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; null texts and texts without letters go."""
    network = lang_gru.train(docs.where(~lang_gru.held_out()))
    names = docs.columns
    marked = lang_gru.identify(docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("text")), network)
    return marked.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SURE)).select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't called toxic; learnt from labels of the rows that op4 learns from. Null and empty
    texts are judged like texts without words; repeated rows get one verdict each; columns of any names pass through."""
    labels = _read(spark, sf_dir, "labels").where(~lang_gru.held_out("doc_id", 3, 1))
    own = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), "doc_id", "text", "lang")
    judged = toxic_cnn.judge(own.select("row", "doc_id", "text"), toxic_cnn.train(own, labels)).drop("text")
    judged = staged(judged, "judged")
    cuts = toxic_cnn.calibrate(judged.select("doc_id", "logit", "guess"), labels)
    return toxic_cnn.decide(judged, cuts).where("predicted = 0").select("row.*")


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the smallest doc_id, nulls last. Unlike texts stay, whatever their doc_id."""
    names = docs.columns
    out, repeated = near_copies.dropped(docs)
    held = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), "doc_id", near_copies.digest().alias("digest"))
    held = near_copies.left_out(held, out)
    if repeated:
        held = held.dropDuplicates(["doc_id", "digest"])
    return held.select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a benchmark window; null and wordless texts have none and stay, as do repeated rows;
    columns of any names pass through."""
    names = docs.columns
    marked = decontam.contamination(docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("text")), _read(spark, sf_dir, "benchmark"))
    return marked.where("not contaminated").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is one piece, the end id; repeated rows are packed each."""
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", toxicity), ("near-dedup", near_copies_out), ("decontaminate", decontaminate), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
