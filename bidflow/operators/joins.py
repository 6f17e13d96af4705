"""Joins whose match depends on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bidflow.operators.ordered import running


def latest_match_join(
    left: DataFrame, right: DataFrame, key: str, time: str, left_order: str, right_order: str
) -> DataFrame:
    """Each right row with the newest left row at or before it, else with the first later one.

    Both inputs have `key`, `time` and an order column breaking ties of time; at equal times left
    rows count as earlier. Matches only. All left columns come back prefixed `left_`, right ones
    `right_`. The two sides are merged into one ordered pass, so a key with many rows on both
    sides costs a sort, not a product.
    """
    def side(df, tag, order, own, other, other_df):
        return df.select(
            F.col(key),
            F.col(time),
            F.lit(tag).alias("_tag"),
            F.col(order).alias("_order"),
            F.struct(*df.columns).alias(own),
            F.lit(None).cast(other_df.select(F.struct("*").alias("s")).schema["s"].dataType).alias(other),
        )

    merged = side(left, 0, left_order, "_left", "_right", right).unionByName(
        side(right, 1, right_order, "_right", "_left", left)
    )
    matched = running(
        merged,
        [key],
        [time, "_tag", "_order"],
        latest={"_before": F.col("_left")},
        following={"_after": F.col("_left")},
    )
    match = F.coalesce("_before", "_after")
    left_columns = [c for c in left.columns if c != key]
    right_columns = [c for c in right.columns if c != key]
    return (
        matched.where(F.col("_right").isNotNull() & match.isNotNull())
        .withColumn("_match", match)
        .select(
            key,
            *[F.col(f"_match.{c}").alias(f"left_{c}") for c in left_columns],
            *[F.col(f"_right.{c}").alias(f"right_{c}") for c in right_columns],
        )
    )
