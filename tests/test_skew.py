"""Skew-proof forms against the plain ones on inputs where one key holds most rows."""

import pytest
from pyspark.sql import Window, functions as F

from bidflow.operators.ordered import last_n_sums, running
from bidflow.operators.skew import balanced_join, hot_keys
from bidflow.operators.sizing import SMALL_INPUT_CONF


@pytest.fixture
def skewed(spark):
    """3000 rows; key 0 holds two thirds of them and many rows share one time."""
    return (
        spark.range(3000)
        .selectExpr(
            "id", "CASE WHEN id % 3 < 2 THEN 0 ELSE id % 40 END AS key",
            "CASE WHEN id % 5 = 0 THEN 7 ELSE hash(id) % 50 END AS ts", "id * 31 % 101 AS v",
        )
        .withColumn("opt", F.when(F.col("id") % 4 == 0, F.col("v")))
        .repartition(6)
    )


def same(a, b):
    columns = sorted(a.columns)
    left, right = a.select(columns), b.select(columns)
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


@pytest.mark.parametrize("slices", [1, 2, 13])
def test_running(skewed, slices, small):
    values = dict(
        rank="n", sums={"total": F.col("v"), "opt_total": F.col("opt")}, maxima={"top": F.col("opt")}, latest={"seen": F.col("opt")},
        previous={"prev": F.col("opt")}, following={"next": F.col("opt")},
    )
    plain = running(skewed, ["key"], ["ts", "id"], **values)
    sliced = running(skewed, ["key"], ["ts", "id"], **values, slices=slices)
    assert sliced.count() == 3000
    assert same(plain, sliced)
    w = Window.partitionBy("key").orderBy("ts", "id")
    direct = skewed.withColumns({
        "total": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "next": F.first("opt", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        "n": F.row_number().over(w).cast("bigint"),
    })
    assert same(direct, sliced.select(*direct.columns))


@pytest.mark.parametrize("slices", [2, 13])
def test_running_with_null_keys_and_times(skewed, slices):
    """Half of the rows have no key, some no time; both are ordinary values of their columns."""
    rows = skewed.withColumns({"key": F.when(F.col("id") % 2 == 0, F.col("key")), "ts": F.when(F.col("id") % 11 > 0, F.col("ts"))})
    values = dict(rank="n", sums={"total": F.col("v")}, latest={"seen": F.col("opt")}, following={"next": F.col("opt")})
    assert same(running(rows, ["key"], ["ts", "id"], **values, slices=1), running(rows, ["key"], ["ts", "id"], **values, slices=slices))


def test_running_shuffles_its_input_once(spark, skewed):
    executed = running(skewed, ["key"], ["ts", "id"], sums={"total": F.col("v")}, slices=7)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning(key") - executed.count("partial_sum") <= 2 and "rangepartitioning" not in executed


@pytest.mark.parametrize("n", [10, 300])
@pytest.mark.parametrize("block", [10, 64, 100_000])
def test_last_n_sums(skewed, n, block, small):
    sums = {"s": F.col("v"), "c": F.lit(1).cast("bigint")}
    plain = last_n_sums(skewed, ["key"], ["ts", "id"], n, sums, slices=1)
    sliced = last_n_sums(skewed, ["key"], ["ts", "id"], n, sums, block=block, slices=7)
    assert same(plain, sliced)


@pytest.mark.parametrize("rows_per_salt", [5, 100, 10**9])
@pytest.mark.parametrize("copies", [1, 50])
def test_balanced_join(spark, skewed, rows_per_salt, copies):
    """Also with exact copies: rows spread by content alone would stay together."""
    many = skewed.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_c").repartition(5)
    one = spark.range(60).selectExpr("id AS k", "id * 10 AS w")
    expected = many.join(one, (many.key == one.k) & (many.v < 60))
    spark.conf.set(SMALL_INPUT_CONF, "0")
    try:
        found = balanced_join(many, one, "key", "k", F.col("v") < 60, rows_per_salt=rows_per_salt)
        assert same(expected, found)
    finally:
        spark.conf.unset(SMALL_INPUT_CONF)


def test_balanced_join_on_two_columns(spark, skewed):
    one = spark.range(60).selectExpr("id AS k", "7 AS t", "id * 10 AS w")
    expected = skewed.join(one, (skewed.key == one.k) & (skewed.ts == one.t))
    spark.conf.set(SMALL_INPUT_CONF, "0")
    try:
        assert same(expected, balanced_join(skewed, one, ["key", "ts"], ["k", "t"], rows_per_salt=20))
    finally:
        spark.conf.unset(SMALL_INPUT_CONF)


def test_hot_keys_are_found(skewed):
    found = {r["_hot_key"]: r["_salts"] for r in hot_keys(skewed, ["key"], rows_per_salt=500).collect()}
    assert set(found) == {0} and found[0] >= 4


def test_no_hot_keys_on_empty_input(spark):
    assert hot_keys(spark.range(0), ["id"]).count() == 0


def test_salted_rows_spread(spark, skewed):
    """No task of the join gets more than a small part of the hot key."""
    spark.conf.set(SMALL_INPUT_CONF, "0")
    try:
        one = spark.range(60).selectExpr("id AS k", "id * 10 AS w")
        joined = balanced_join(skewed, one, "key", "k", rows_per_salt=50)
        # Broadcasting the small side would hide the shuffle this test is about.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        per_task = joined.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        assert per_task < 3000 / 16 * 3
    finally:
        spark.conf.unset(SMALL_INPUT_CONF)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
