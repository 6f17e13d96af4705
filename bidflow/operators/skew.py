"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bidflow.operators.sizing import is_small

# Frequent-items sketches over SKETCH_ITEMS counters miss a key only below a share of about
# 1 / (0.75 * SKETCH_ITEMS) of the rows they see. Input partitions are sketched in SKETCH_GROUPS
# groups, so no task merges the sketches of all of them.
SKETCH_ITEMS = 32_768
SKETCH_TOP = 8_192
SKETCH_GROUPS = 1024
HOT_KEYS = 32_768
ROWS_PER_SALT = 2_000_000
MAX_SALTS = 262_144


def _as_one(keys: list[str]) -> Column:
    """The key as one value the sketch can count: the column itself, or text for several columns."""
    if len(keys) == 1:
        return F.col(keys[0])
    return F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))


def hot_keys(df: DataFrame, keys: list[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """At most HOT_KEYS rows (_hot_key, _salts): the keys to split and into how many parts.

    One pass over the key columns; what is shuffled are sketches of constant size per task.
    The sketches only decide how rows are spread. They never decide whether a row is kept.
    """
    sketched = (
        df.select(_as_one(keys).alias("_k"), F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("_group"))
        .where(F.col("_k").isNotNull())
        .groupBy("_group")
        .agg(F.expr(f"approx_top_k(_k, {SKETCH_TOP}, {SKETCH_ITEMS})").alias("top"))
    )
    return (
        sketched.select(F.explode("top").alias("entry"))
        .groupBy(F.col("entry.item").alias("_hot_key"))
        .agg(F.sum("entry.count").alias("_rows"))
        .where(F.col("_rows") > rows_per_salt)
        .orderBy(F.col("_rows").desc())
        .limit(HOT_KEYS)
        .select("_hot_key", F.least(F.ceil(F.col("_rows") / rows_per_salt), F.lit(MAX_SALTS)).cast("int").alias("_salts"))
    )


def balanced_join(
    many: DataFrame,
    one: DataFrame,
    many_key: str | list[str],
    one_key: str | list[str],
    condition: Column | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Inner equi-join `many.many_key = one.one_key` (and `condition`), `one` unique by its key.

    Column names of the two sides must not overlap. Large inputs are looked at first: if there are
    hot keys, their rows are spread over parts and the single matching row of `one` is repeated once
    per part. The part number depends on the row and its input partition only, so a re-run task
    sends rows to the same place.
    """
    many_keys = [many_key] if isinstance(many_key, str) else many_key
    one_keys = [one_key] if isinstance(one_key, str) else one_key
    on = F.col(many_keys[0]) == F.col(one_keys[0])
    for left, right in zip(many_keys[1:], one_keys[1:]):
        on = on & (F.col(left) == F.col(right))
    if condition is not None:
        on = on & condition
    if is_small(many, one):
        return many.join(one, on, "inner")

    # At most HOT_KEYS rows come back, and none at all when the keys are even.
    hot = many.sparkSession.createDataFrame(hot_keys(many, many_keys, rows_per_salt).toArrow())
    if hot.isEmpty():
        return many.join(one, on, "inner")

    salts = F.coalesce("_salts", F.lit(1))
    spread = F.pmod(F.xxhash64(*many.columns) + F.spark_partition_id(), salts)
    spread_many = (
        many.join(F.broadcast(hot), _as_one(many_keys) == F.col("_hot_key"), "left")
        .withColumn("_part", F.when(salts > 1, spread).otherwise(0).cast("int"))
        .drop("_hot_key", "_salts")
    )
    spread_one = (
        one.join(F.broadcast(hot), _as_one(one_keys) == F.col("_hot_key"), "left")
        .withColumn("_one_part", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_hot_key", "_salts")
    )
    return spread_many.join(spread_one, on & (F.col("_part") == F.col("_one_part")), "inner").drop(
        "_part", "_one_part"
    )
