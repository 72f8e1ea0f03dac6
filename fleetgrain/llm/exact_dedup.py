"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, kept in the warehouse. New data is
reduced to one row per digest, anti-joined with the index by sort-merge over the same
buckets (the index is neither shuffled nor sorted again) and the rest is appended.

Digests are SHA-256 of the text with each run of white space replaced by one space.
Counting and the smallest id combine on the map side, so a digest with a third of all
rows sends one row per task; the join back to rows is an ordinary one that AQE splits.

Defined cases: null counts as the empty text and all such rows are one group; of equal
texts of one batch the smallest id stays; a text that an earlier batch put into the
index keeps that row; repeated (id, text) rows count as rows of the group; an empty
table appends nothing; only the id and text columns are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrain.llm.common import stored

BUCKETS = 32


def text_digest(text: Column) -> Column:
    normal = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    return F.unhex(F.sha2(normal, 256))


class DigestIndex:
    """Digests seen so far with the id that stays, as a bucketed and sorted table."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets

    @classmethod
    def fresh(cls, spark: SparkSession, buckets: int = BUCKETS) -> DigestIndex:
        return cls(spark, f"digest_index_{uuid.uuid4().hex}", buckets)

    def rows(self) -> DataFrame | None:
        if not self.spark.catalog.tableExists(self.name):
            return None
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, firsts: DataFrame) -> None:
        """Append the (digest, keep_id) rows whose digest the index lacks."""
        known = self.rows()
        new = firsts.repartition(self.buckets, "digest")
        if known is not None:
            new = new.join(known.select("digest").hint("merge"), "digest", "left_anti")
        (
            new.sortWithinPartitions("digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of every row, stored: the text is read once."""
    return stored(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest")), "digests")


def ingest(batch: DataFrame, index: DigestIndex) -> DataFrame:
    """Add a batch of (doc_id, digest) rows to the index.

    Returns one stored row per digest of the batch: digest, keep_id (of the index) and
    group_size (rows of this batch).
    """
    groups = stored(batch.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")), "digest-groups")
    index.append(groups.select("digest", F.col("first_id").alias("keep_id")))
    settled = groups.join(index.rows().hint("merge"), "digest")
    return stored(settled.select("digest", "keep_id", "group_size"), "digest-settled")


def members(rows: DataFrame, settled: list[DataFrame]) -> DataFrame:
    """A row per document over all batches: doc_id, digest, keep_id, group_size, kept.

    The groups are stored first: a join that also carries their aggregation could not
    be split at a hot digest.

    A row whose id equals that of the row that stays is kept, so repeats of one id with
    one text are all kept.
    """
    parts = settled[0]
    for more in settled[1:]:
        parts = parts.unionByName(more)
    groups = stored(
        parts.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "digest-totals"
    )
    return rows.join(groups, "digest").select(
        "doc_id", "digest", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept")
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole-table deduplication: the rows arrive in `batches` ranges of ascending id.

    Later batches meet the index of the earlier ones, so the anti-join decides what is
    new; as ids ascend, the row that stays is the one with the smallest id. Without an
    `index` that outlives the call, one is made for it and dropped.
    """
    rows, settled = digests(docs, id_col, text_col), []
    own = index is None
    index = index or DigestIndex.fresh(docs.sparkSession)
    cuts = rows.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:], strict=False):
        within = F.lit(True)
        if low is not None:
            within = within & (F.col("doc_id") > low)
        if high is not None:
            within = within & (F.col("doc_id") <= high)
        if high is None:
            within = within | F.col("doc_id").isNull()
        settled.append(ingest(rows.where(within), index))
    if own:
        index.drop()
    return members(rows, settled)
