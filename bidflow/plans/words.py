"""Keyed word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bidflow.operators.ordered import running


def word_count(words: DataFrame) -> DataFrame:
    return words.groupBy("key").agg(F.sum("val").alias("total"))


def word_count_running(words: DataFrame, order: list[str]) -> DataFrame:
    """(key, total so far) for every input row; the order columns are kept."""
    return running(words, ["key"], order, sums={"total": F.col("val")}).select(*order, "key", "total")


def time_ordered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds each row's position in event-time order within its key."""
    return running(df, keys, order, rank="position")
