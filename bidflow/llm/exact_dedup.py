"""Operator 5, exact dedup: a persistent index of text digests, bucketed and sorted by digest.

Only DataFrame operations. A new batch is digested, grouped with partial aggregation, anti-joined with
the index by sort-merge join (the index side is neither shuffled nor sorted), and what is new is
appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm.shared import join_groups, table, text_of
from bidflow.operators.sizing import scratch_folder


def normalised(column: str = "text"):
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(text_of(column), r"[\x20\x09-\x0D]+", " ")


class DigestIndex:
    """Digests seen so far with the doc_id that stays: a bucketed table in the session's catalog.

    `location` keeps the files in a folder of the caller's choice, else they go to the warehouse.
    `buckets` is fixed when the table is made: about one per 128 MB of expected index, 80 bytes a text.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 16, location: str | None = None):
        self.spark, self.name, self.buckets, self.location = spark, name, buckets, location
        if not spark.catalog.tableExists(name):
            self._write(spark.createDataFrame([], "digest string, keep_id long"))

    def _write(self, rows: DataFrame) -> None:
        writer = rows.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        if self.location:
            writer = writer.option("path", self.location)
        writer.saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame) -> DataFrame:
        """Takes in a batch (doc_id, text; other columns are ignored) and returns one row per document.

        doc_id, keep_id (an earlier batch's document wins, then the smallest doc_id of this batch),
        group_size (rows of this batch with the text), kept, text_sha256. Rows that share doc_id and
        text are the same document and marked alike; null ids come last. An empty batch changes nothing.
        """
        folder = scratch_folder(self.spark, "exact")
        docs.select("doc_id", F.sha2(normalised(), 256).alias("digest")).write.parquet(f"{folder}/digests")
        digests = self.spark.read.schema("doc_id long, digest string").parquet(f"{folder}/digests")
        digests.groupBy("digest").agg(F.min("doc_id").alias("new_id"), F.count("*").alias("n")).join(
            self.rows().withColumn("known", F.lit(True)).hint("merge"), "digest", "left"
        ).select(
            # The row that an earlier batch kept wins, also if it has no id.
            "digest", "n", F.when(F.col("known"), F.col("keep_id")).otherwise(F.col("new_id")).alias("keep_id"),
            F.coalesce("known", F.lit(False)).alias("known"),
        ).write.parquet(f"{folder}/groups")
        groups = self.spark.read.schema("digest string, n long, keep_id long, known boolean").parquet(f"{folder}/groups")
        fresh = groups.select("digest", "keep_id").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self._write(fresh.repartition(self.buckets, "digest"))

        return join_groups(digests, groups, "digest", "n", digests.count()).select(
            "doc_id", "keep_id", F.col("n").alias("group_size"),
            (~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


#: Digests in a bucket of the index, about 160 MB.
BUCKET_ROWS = 2_000_000


def exact_dedup(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per document against a new index of its own, with buckets for as many digests as there are rows."""
    spark = docs.sparkSession
    buckets = buckets or max(16, -(-docs.count() // BUCKET_ROWS))
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets).add(docs)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_OP5 = r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
    FROM d"""
