"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrain.llm import (
    exact_dedup, hard_negatives, html_extract, license_scan, ngram_join, packing, piece_codec, quality_rules, secret_scan, seed_extend, spelling_variants, suffix_dedup, warc,
)
from fleetgrain.llm.common import table, vocabulary
from fleetgrain.llm.oracles import all_sql


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return rows.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE))
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{kind.name}") for k, kind in enumerate(secret_scan.BASE)],
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, vec_id = F.col("label"), F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), hard_negatives.whole_vectors(F.col("embedding"), 256).alias("vector")
    )
    return hard_negatives.mine(rows, vec_id % 100 == 0)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_extend.deduplicate(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_sentencepiece, op3_packing, op4_warc, op5_exact_dedup, op6_secret_scan, op7_suffix_dedup,
        op8_license_scan, op9_html_extraction, op10_ngram_join, op11_spelling_variants, op12_hard_negatives, op13_substring_dedup,
    )
}

ORACLES: dict[str, str] = all_sql()
