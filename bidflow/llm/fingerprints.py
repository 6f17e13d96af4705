"""Operator 10, document fingerprints: the k smallest hashes of a text's word shingles.

Such sketches merge by union, and two of them estimate resemblance, containment and the number of
distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidflow.llm.shared import bytes_of, pieces, shingle_hashes, table, text_of, total_bytes

K = 128
WIDTH = 5
SPAN = float(1 << 48)
PIECE = 1 << 20
#: Text per range of doc_ids in `with_next`, and ranges at most: beyond 128 GB they grow, sorted with spilling, and what the
#: driver gets stays below 512 KB.
RANGE_BYTES, RANGES = 8 << 20, 1 << 14
LAST = -(1 << 63)


def sketches(texts: list[str], k: int = K) -> list[np.ndarray]:
    """The k smallest distinct 48-bit shingle hashes of each text, ascending; none for a text without words."""
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)
    hashes, where, _ = shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), bounds, WIDTH)
    hashes >>= np.uint64(16)
    return [np.unique(hashes[a:b])[:k] for a, b in zip(where[:-1], where[1:])]


def to_text(sketch: np.ndarray) -> str:
    """Six bytes a hash, big end first, in base64: eight characters each, in the order of the hashes."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6).astype(np.uint64)
    return (raw << np.arange(40, -8, -8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Shared shingles over all; 1 for two empty sketches, and exact when the union has at most k shingles."""
    union = merged(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], side="right")) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * SPAN / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The part of a's shingles that b has; 1 if a has none."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct(merged(a, b, k), k)
    return min(1.0, shared / distinct(a, k))


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fingerprint, n_distinct (estimated number of distinct shingles) of every text; null is empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            made = sketches(batch.column(1).to_pylist(), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(to_text, made), pa.string()), pa.array((distinct(s, k) for s in made), pa.float64())],
                ["doc_id", "fingerprint", "n_distinct"],
            )

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_distinct double")


def group_fingerprints(docs: DataFrame, key: str, k: int = K) -> DataFrame:
    """One sketch for all texts with the same key: key, fingerprint, n_distinct.

    A task first merges what it has of each key, so a hot key brings one sketch per task to the last step.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str | None, np.ndarray] = {}
        for batch in pieces(batches, "text", PIECE):
            for name, made in zip(batch.column(0).to_pylist(), sketches(batch.column(1).to_pylist(), k)):
                have[name] = merged(have[name], made, k) if name in have else made
        yield pa.RecordBatch.from_arrays(
            [pa.array(have.keys(), pa.string()), pa.array(map(to_text, have.values()), pa.string())], ["key", "fingerprint"]
        )

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(0, np.uint64)
        for text in rows["fingerprint"]:
            out = merged(out, from_text(text), k)
        return pd.DataFrame({"key": rows["key"].iloc[:1], "fingerprint": [to_text(out)], "n_distinct": [distinct(out, k)]})

    parts = docs.select(F.col(key).cast("string").alias("key"), text_of().alias("text")).mapInArrow(part, "key string, fingerprint string")
    return parts.groupBy("key").applyInPandas(whole, "key string, fingerprint string, n_distinct double").withColumnRenamed("key", key)


def with_next(docs: DataFrame) -> DataFrame:
    """Deals documents to ranges of doc_id: columns range, guest, id, doc_id, text, sorted within partitions.

    Ids are descending, null last, ties by text. Each range ends with a guest, the first document of
    the next range (of the first range, after the last), so every document is followed by its next one.
    One shuffle of the texts; a range holds about `RANGE_BYTES`, and the driver gets two ids for each of at most `RANGES`.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "doc_id", text_of().alias("text"))
    n = max(1, min(RANGES, -(-total_bytes(rows) // RANGE_BYTES)))
    edges = (
        rows.select("id").repartitionByRange(n, "id").groupBy(F.spark_partition_id().alias("p"))
        .agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("low").collect()
    )
    lows = np.array([r.low for r in edges] or [LAST], np.int64)
    heads = np.array([r.high for r in edges] or [LAST], np.int64)
    count = len(lows)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ranges(ids: pd.Series) -> pd.Series:
        # A head is also the guest of the range above; the topmost head is the guest of the lowest range.
        own = np.searchsorted(lows, ids.to_numpy(), side="right") - 1
        head = heads[own] == ids.to_numpy()
        return pd.Series([[2 * o, 2 * ((o + 1) % count) + 1] if h else [2 * o] for o, h in zip(own.tolist(), head)])

    target = F.explode(ranges("id"))
    parts = max(1, min(count, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return (
        rows.select("*", target.alias("to"))
        .select(F.expr("to div 2").alias("range"), F.expr("to % 2 = 1").alias("guest"), "id", "doc_id", "text")
        .repartition(max(parts, count // 4), "range")
        .sortWithinPartitions("range", "guest", F.desc("id"), "text")
    )


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by the start of another text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def likenesses(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next smaller id, after the last the first; null ids come last, and
    documents that share an id follow each other by text. A lone document is its own next.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        for batch in pieces(batches, "text", PIECE):
            texts = batch.column(3).to_pylist()
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts, sketches(texts, k)))
            rows = [last, *rows] if last else rows
            last = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
            changed = [edited(a[3], b[3]) for a, b in pairs]
            others = sketches(changed, k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array([to_text(a[4]) for a, _ in pairs], pa.string()),
                    pa.array([to_text(s) for s in others], pa.string()),
                    pa.array([resemblance(a[4], s, k) for (a, _), s in zip(pairs, others)], pa.float64()),
                    pa.array([resemblance(a[4], b[4], k) for a, b in pairs], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(docs).select("range", "guest", "doc_id", "text").mapInArrow(run, schema)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likenesses(table(spark, sf_dir, "documents"))
