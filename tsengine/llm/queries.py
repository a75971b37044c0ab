"""A query per operator, with production parameters over whole tables, and the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tsengine.llm import context_tree, decontamination, host_rules, line_crf, merkle, mixing, near_duplicates, packing, token_alignment, toxicity, url_filter, warc, wrappers
from tsengine.llm.common import held_out
from tsengine.llm.oracles import ORACLES
from tsengine.session import scratch_path

__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, spec = _table(spark, folder, "documents"), line_crf.Spec()
    model = line_crf.learn(docs, _table(spark, folder, "labels"), spec, modulus=4, held=2)
    scored = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), line_crf.score(F.col("text"), model, spec).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= spec.threshold).cast("int"))


def op3_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "source", "text")
    judged = host_rules.judge(docs)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, spec = _table(spark, folder, "documents"), toxicity.Spec()
    model = toxicity.learn(docs, _table(spark, folder, "labels"), spec, modulus=5, held=0)
    scored = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= spec.threshold).cast("int"))


def op6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op7_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return context_tree.language_scores(_table(spark, folder, "documents"))


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.main_texts(_table(spark, folder, "pages"))


def op9_revisits(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.resolve_revisits(warc.headers(_table(spark, folder, "pages")))
    path = scratch_path(spark, "warc")
    warc.write_archive(records, path)
    read = warc.read_archive(spark, path, with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(_table(spark, folder, "documents"))


def op11_align(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.counted(_table(spark, folder, "documents"))


def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.verdicts(_table(spark, folder, "pages"), url_filter.default_list(spark))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified(_table(spark, folder, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_host_rules": op3_host_rules,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_toxicity": op5_toxicity,
    "op6_pack": op6_pack,
    "op7_context_tree": op7_context_tree,
    "op8_main_text": op8_main_text,
    "op9_revisits": op9_revisits,
    "op10_mix": op10_mix,
    "op11_align": op11_align,
    "op12_url_filter": op12_url_filter,
    "op13_merkle": op13_merkle,
}
