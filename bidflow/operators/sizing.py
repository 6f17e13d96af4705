"""Input-size checks and lineage cuts used to choose between plan shapes.

Every operator that could put one key's rows into one task has two exact forms: a plain one for
inputs whose scanned bytes are known to be small, and a skew-proof one for everything else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL_INPUT_CONF = "spark.bidflow.smallInputBytes"
SMALL_INPUT_BYTES = 64 << 20
SLICE_CONF = "spark.bidflow.sliceBytes"
SLICE_BYTES = 128 << 20
MAX_SLICES = 16_384
UNKNOWN_BYTES = 1 << 60


def scanned_bytes(df: DataFrame) -> int | None:
    """Bytes of all leaves of the optimized plan; None if the session cannot tell.

    Leaves are summed (not the root estimate) because the root multiplies the two sides of a join.
    Leaves without statistics report the session default, which is huge, so they count as large.
    """
    jdf = getattr(df, "_jdf", None)
    if jdf is None:
        return None
    leaves = jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += int(str(leaves.next().stats().sizeInBytes()))
    return total


def is_small(*dfs: DataFrame) -> bool:
    """True when all inputs together are known to scan fewer bytes than the session's limit."""
    limit = int(dfs[0].sparkSession.conf.get(SMALL_INPUT_CONF, str(SMALL_INPUT_BYTES)))
    total = 0
    for df in dfs:
        size = scanned_bytes(df)
        if size is None:
            return False
        total += size
    return total < limit


def slice_count(df: DataFrame) -> int:
    """Slices for running values: one per `sliceBytes` scanned, or one per shuffle partition if unknown.

    Slices only divide keys with more rows than fit one; hashing by key and slice spreads all others.
    The bounds are literals of the plan, so there are at most MAX_SLICES: up to 2 TB a slice has 128 MB, and
    beyond that a key that holds everything has slices that grow with the input.
    """
    spark = df.sparkSession
    size = scanned_bytes(df)
    if size is None or size >= UNKNOWN_BYTES:
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, min(-(-size // int(spark.conf.get(SLICE_CONF, str(SLICE_BYTES)))), MAX_SLICES))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint directory."""
    base = shared_folder(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset, one in the shared warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows once and reads them back: what every later step sees, also after executor loss.

    A written table rather than a checkpoint, because its real size is known to the plans built on
    it and each of them reads only the columns it needs.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reusable(df: DataFrame) -> DataFrame:
    """A result that is read several times: as it is when cheap to repeat, else written once."""
    return df if is_small(df) else materialize(df)
