"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import collocations, decontaminate, divergence, htmltext, langid, licenses, linededup, ngramjoin, oracles, packing, quality, sharding, tokens, toxicity
from pairloom.llm.common import held_out, read

SHARDS = 8


TOKEN_LIMIT = 4096


def op1_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    away = held_out("doc_id", 3, 1)
    model = langid.train(docs.filter(~away))
    return langid.predict(docs.withColumn("held_out", away), model, keep=["doc_id", "held_out"])


def op2_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), keep_ids=False)


def op3_template_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_main_text(read(spark, sf_dir, "pages"))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "coverage", "consistency")


def op5_partenum_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.prefix_token_counts(read(spark, sf_dir, "documents"), store=False)
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op8_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 5, 0))
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out("doc_id", 5, 0))
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model, keep=("doc_id", "held_out"))


def op9_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "removed", F.length("text").cast("long").alias("kept_chars"))


def op10_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(read(spark, sf_dir, "documents"))


def op13_license_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ftrl_language_id, op2_hierarchical_packing, op3_template_html_text, op4_template_decontamination, op5_partenum_jaccard_join, op6_prefix_token_counts, op7_line_frequency_rules, op8_levenshtein_toxicity, op9_segment_line_dedup, op10_prefix_sum_shards, op11_source_divergence, op12_phrase_collocations, op13_license_containment)}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
