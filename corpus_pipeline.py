"""A training corpus from raw documents: language, exact copies, near copies, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written and read again before the next
one. All but the last keep the columns of documents. Empty tables pass through as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm import exact_dedup, language, mixing, near_dedup, pieces
from bidflow.operators.sizing import scratch_folder

#: Documents whose language has a smaller share of the text than this, or no language, go.
LEAST_SHARE = 0.5
#: Percent of shingles in common from which documents are near copies.
SIMILARITY = 80
#: SQL cannot express the language model nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def whole_rows(docs: DataFrame, *columns) -> DataFrame:
    """The rows of docs in one column `doc`, out of the way of names that a stage joins, beside some of their columns."""
    return docs.select(F.struct("*").alias("doc"), *columns)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language has at least `LEAST_SHARE` of the text; learns from the labels of those not held out.

    How sure op2 is of the language plays no part: two languages in one text make it unsure of either. If no label can
    be learned (all null or held out), no document has a language and none is kept.
    """
    langs, model = language.train(docs.filter(~language.held_out()))
    seen = language.identify(whole_rows(docs, "text"), langs, model)
    share = F.col("shares")[F.col("lang_pred")]
    return seen.filter((F.col("lang_pred") != language.UNDETERMINED) & (share >= LEAST_SHARE)).select("doc.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of equal texts; of rows that repeat it, one."""
    kept = exact_dedup.exact_dedup(docs).filter("kept").groupBy(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_digest"))
    own = whole_rows(docs, "doc_id", F.sha2(exact_dedup.normalised(), 256).alias("digest"))
    found = own.join(
        kept.agg(F.count("*").alias("rows")), F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    )
    once = found.filter("rows > 1").dropDuplicates(["doc_id", "digest"])
    return found.filter("rows = 1").select("doc.*").unionByName(once.select("doc.*"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component, and those without a doc_id."""
    gone = near_dedup.near_dedup(docs, SIMILARITY).filter("NOT kept").select("doc_id").distinct()
    return whole_rows(docs, "doc_id").join(gone, "doc_id", "left_anti").select("doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it, to the nearest whole number; zero drops it."""
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("mix_id")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    found = whole_rows(docs, "doc_id").join(taken, F.col("doc_id").eqNullSafe(F.col("mix_id"))).withColumn("copies", copies)
    return found.filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, the end id last, with digests of ids and of the decoded text."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language identification", by_language),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
