"""The registered queries of the training-data operators, one for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arrow_tokens, chat, decontam, lang_gru, licenses, line_rules, packing, sharding, simhash, toxic_cnn
from .token_ids import vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op2_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op3_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_tokens.read(arrow_tokens.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_cnn.predicted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_gru.predicted(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.selectExpr("doc_id", "array_join(licenses, ',') AS licenses", "n_candidates", "best_saving", "array_join(spans, ',') AS line_spans")


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_quality(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_label_propagation": op2_label_propagation,
    "op3_arrow_tokens": op3_arrow_tokens,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_language": op6_language,
    "op7_packing": op7_packing,
    "op8_licenses": op8_licenses,
    "op9_line_rules": op9_line_rules,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {"op1_chat": chat.SQL, "op9_line_rules": line_rules.SQL, "op10_decontaminate": decontam.SQL}
