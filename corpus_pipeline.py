"""The corpus pipeline: each stage works on all rows that the stage before kept.

Every stage is one operator of `fleetgrain.llm`; `run` writes its rows as Parquet below
the shared folder and gives the next stage the written table. All stages but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetgrain.llm import exact_dedup, ngram_join, packing, quality_rules, secret_scan
from fleetgrain.llm.common import stored, table, vocabulary, without


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules."""
    return quality_rules.kept_rows(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, the one with the smallest id."""
    dropped = stored(exact_dedup.deduplicate(docs).where("doc_id IS NOT NULL AND NOT kept").select("doc_id"), "pipeline-copies")
    return without(docs, "doc_id", dropped, "doc_id")


#: Near duplicates share 80 % of their five-word shingles, as near-duplicate stages do by default;
#: the four words and 85 % of the query of the same operator are that query's contract.
NEAR = ngram_join.Rule(words=5, percent=80)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the row with the smallest id."""
    joined = ngram_join.join(docs, rule=NEAR).where("doc_id <> component_id")
    return without(docs, "doc_id", stored(joined.select("doc_id"), "pipeline-near"), "doc_id")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with live-looking secrets replaced in their texts."""
    return secret_scan.redact_live(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("secret_scan", secrets),
    ("packing", pack),
]

#: The last stage needs a tokenizer, which SQL has not; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
