"""Signed multisets: tables with a `time` and a `diff` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def as_changelog(df: DataFrame, time: Column, diff: int = 1) -> DataFrame:
    """Every row becomes one insertion (or deletion) at `time`."""
    return df.withColumns({"time": time, "diff": F.lit(diff).cast("bigint")})


def consolidate(changes: DataFrame) -> DataFrame:
    """Adds up `diff` of equal (record, time) and drops what cancels."""
    record = [c for c in changes.columns if c != "diff"]
    return changes.groupBy(*record).agg(F.sum("diff").alias("diff")).where("diff != 0")


def negate(changes: DataFrame) -> DataFrame:
    return changes.withColumn("diff", -F.col("diff"))


def concat(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def shift_time(changes: DataFrame, time: Column) -> DataFrame:
    """Moves the effective time of each record."""
    return changes.withColumn("time", time)


def top1(df: DataFrame, keys: list[str], best_first: list[Column]) -> DataFrame:
    """One best record per key, smallest by `best_first` (negate a number for "largest").

    A minimum over one struct: combined per task before the shuffle, so hot keys stay cheap.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(
        *[c.alias(f"_rank{i}") for i, c in enumerate(best_first)], F.struct(*rest).alias("record")
    )
    return df.groupBy(*keys).agg(F.min(rank).alias("best")).select(*keys, "best.record.*")


def sliding_changelog(slot_counts: DataFrame, slices: int, slide_seconds: int) -> DataFrame:
    """Additions at the end of each slot, deletions one window later: (auction, time, diff).

    Takes counts per (slot_end, auction), so at most two rows per count are shuffled.
    """
    width = slices * slide_seconds
    signs = F.array(
        F.struct(F.col("slot_end").alias("time"), F.col("bids").alias("diff")),
        F.struct(
            (F.col("slot_end") + F.expr(f"make_dt_interval(0, 0, 0, {width})")).alias("time"),
            (-F.col("bids")).alias("diff"),
        ),
    )
    changes = slot_counts.select("auction", F.explode(signs).alias("s")).select("auction", "s.time", "s.diff")
    return consolidate(changes)


def verify_equal(correct: DataFrame, output: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs between two multisets; empty when they are equal.

    One aggregation over the tagged union: no join, no sort, and copies are counted map-side.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    tagged = correct.select("*", one.alias("_correct"), none.alias("_output")).unionByName(
        output.select("*", none.alias("_correct"), one.alias("_output"))
    )
    return (
        tagged.groupBy(*correct.columns)
        .agg(F.sum("_correct").alias("n_correct"), F.sum("_output").alias("n_output"))
        .where("n_correct != n_output")
    )
