"""Operator 9, mixing sources to target weights by Sainte-Laguë apportionment.

The mix is made of blocks of equally many words. Blocks go to sources, and a source's blocks to its
shards, by highest quotients, so quotas are integers and add up. Where a block is too coarse single words
go the same way, so small sources take their targets too. A shard fills its quota by walking
through its documents in a seeded order, again from the start when it reaches the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bidflow.llm.shared import table, text_of
from bidflow.operators.sizing import scratch_folder

BLOCK_WORDS = 16
MOST_REPEATS = 3
SHARD_DOCS = 4000
#: Up to this many sources the table of sources is broadcast (about 100 bytes each).
BROADCAST_SOURCES = 20_000


def targets(sizes: list[int], weights: list[float], most: int = MOST_REPEATS) -> list[float]:
    """Shares of the total by weight; none above `most` times its size, the excess reshared by weight."""
    total = float(sum(sizes))
    out = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), total
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        for i in full or free:
            out[i] = float(most * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        free -= set(full)
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients vote / (2 * seats won + 1), at most `most` each; ties to the earlier.

    A divisor found by halving gives all seats but a few, so the work does not grow with the number of seats.
    """
    votes, most = np.asarray(votes, float), np.where(np.asarray(votes) > 0, most, 0).astype(np.int64)
    seats = int(min(seats, most.sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)

    def won(quotient: float) -> np.ndarray:
        # Seats whose quotient is above the given one.
        return np.minimum(np.maximum(np.ceil((votes / quotient - 1) / 2), 0), most).astype(np.int64)

    low, high = 0.0, float(votes.max())  # won(high) is nothing
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if won(middle).sum() > seats:
            low = middle
        else:
            high = middle
    out = won(high)
    for _ in range(seats - int(out.sum())):  # ties at the divisor: fewer than there are parties
        out[np.argmax(np.where(out < most, votes / (2 * out + 1), -1))] += 1
    return out


def quotas(target: np.ndarray, words: int, most: np.ndarray, block: int) -> np.ndarray:
    """Words of each party by its target, at most `most` each, and `words` in all if that allows it.

    A party whose target is its most takes that. The others take whole blocks, the last one cut at their most;
    parties with targets below a block, and then all for what blocks leave over, take single words.
    """
    target, most = np.asarray(target, float), np.asarray(most, np.int64)
    out = np.where(target >= most, most, 0)
    small, large = (target < most) & (target < block), (target < most) & (target >= block)
    out += sainte_lague(np.where(small, target, 0), min(round(target[small].sum()), words - out.sum()), most)
    blocks = sainte_lague(np.where(large, target, 0), (words - out.sum()) // block, -(-most // block))
    out = np.minimum(out + blocks * block, most)
    return out + sainte_lague(target, words - out.sum(), most - out)


def mix(
    docs: DataFrame, weights: list[float] | None = None, block: int = BLOCK_WORDS, seed: int = 0, most: int = MOST_REPEATS
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    size is the number of words (null text: 0). `weights` go to the sources by code point, null last,
    and repeat; 1, 2, 3 if none are given. taken is the number of words the mix takes, whole passes
    counted as often as they occur; at most `most` times the size. Each source takes its target to
    within a block, or a word if the target is below a block; a target of `most` times the size is taken whole. Empty documents take nothing. Rows that
    share doc_id are counted one by one; which of them the last, partial pass reaches follows their size.
    Only totals of sources reach the driver.
    """
    spark = docs.sparkSession
    weights = weights or [1.0, 2.0, 3.0]
    path = scratch_folder(spark, "mixing")
    docs.select(
        "doc_id", "source", F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size")
    ).write.parquet(path)
    sizes = spark.read.schema("doc_id long, source string, size long").parquet(path)

    totals = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    totals = sorted(totals, key=lambda r: (r.source is None, r.source or ""))
    given = [weights[i % len(weights)] for i in range(len(totals))]
    target = targets([r["size"] for r in totals], given, most)
    given = quotas(np.array(target), round(sum(target)), np.array([most * r["size"] for r in totals]), block)
    rows = [
        (i, r.source, r["size"], target[i], int(given[i]), -(-r.docs // SHARD_DOCS)) for i, r in enumerate(totals)
    ]
    sources = spark.createDataFrame(
        rows, "source_no int, source string, source_size long, target double, source_quota long, shards int"
    ).withColumnRenamed("source", "_source")
    if len(rows) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    dealt = sizes.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "order", F.xxhash64(F.lit(seed), "doc_id")
    ).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("shards")))

    def of_shards(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard", ignore_index=True)
        words, own = part["words"].to_numpy(), int(part["source_quota"].iloc[0])
        quota = quotas(words * (own / max(1, words.sum())), own, most * words, block)
        return part.assign(quota=quota)[["source_no", "shard", "words", "quota"]]

    shards = dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"))
    quota = shards.groupBy("source_no").applyInPandas(of_shards, "source_no int, shard long, words long, quota long")

    order = Window.partitionBy("source_no", "shard").orderBy("order", "doc_id", "size")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rest = F.expr("quota % greatest(words, 1)")
    taken = F.col("size") * F.expr("quota div greatest(words, 1)") + F.greatest(
        F.lit(0), F.least(F.col("size"), rest - F.col("before"))
    )
    return (
        dealt.withColumn("before", before).join(quota.hint("shuffle_hash"), ["source_no", "shard"])
        .select("doc_id", "source", "size", "source_size", "target", taken.cast(T.LongType()).alias("taken"))
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")
