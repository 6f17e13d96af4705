"""Time-versioned routing of keys to bins to workers.

A control table has one row per instruction element:
`ts, sequence, count, kind ('M' full map, 'D' move, 'N' nothing), pos, bin, worker`.
A history is the same information as intervals: `bin, worker, valid_from, valid_to`, where a null
`valid_from` means "since always" and a null `valid_to` means "still valid".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bidflow.operators.ordered import running
from bidflow.operators.sizing import materialize, reusable

# A broadcast history has at most this many intervals (about 40 bytes each) in all, and few enough
# per bin that testing a record against each of them stays cheap.
BROADCAST_INTERVALS = 1_000_000
BROADCAST_INTERVALS_PER_BIN = 64


def initial_map(spark: SparkSession, bins: int, workers: int) -> DataFrame:
    """Round robin: bin b belongs to worker b % workers until control says otherwise."""
    return spark.range(bins).select(
        F.col("id").alias("bin"), (F.col("id") % workers).alias("worker")
    )


def control_violations(control: DataFrame) -> DataFrame:
    """Times whose messages disagree on their sequence number or on `count`, or do not number `count`.

    One message per (ts, sequence, msg); `count` is what each message says to expect at its time.
    """
    messages = control.select("ts", "sequence", "msg", "count").distinct()
    per_time = messages.groupBy("ts").agg(
        F.count(F.lit(1)).alias("messages"),
        F.max("count").alias("expected"),
        F.min("count").alias("least_expected"),
        F.min("sequence").alias("min_sequence"),
        F.max("sequence").alias("max_sequence"),
    )
    wrong = "messages != expected OR least_expected != expected OR min_sequence != max_sequence"
    return per_time.where(wrong).drop("least_expected")


def control_history(control: DataFrame, initial: DataFrame) -> DataFrame:
    """Intervals per bin. Within one time later instructions win: by sequence, then by position.

    A full map and a move both become assignments of single bins, so the history grows with the
    instructions and not with bins x versions. Assignments and history are written once: a log line holds many
    assignments, so what is scanned says little about their number, and both are read several times.
    """
    assigned = (
        control.where("kind != 'N'")
        .groupBy("bin", F.col("ts").alias("valid_from"))
        .agg(F.max_by("worker", F.struct("sequence", "msg", "pos")).alias("worker"))
    )
    start = initial.select(
        "bin", F.lit(None).cast(assigned.schema["valid_from"].dataType).alias("valid_from"), "worker"
    )
    versions = materialize(start.unionByName(assigned))
    history = running(versions, ["bin"], ["valid_from"], following={"valid_to": F.col("valid_from")})
    return materialize(history.select("bin", "worker", "valid_from", "valid_to"))


def distribute(records: DataFrame, bin_of: Column, time: str, history: DataFrame) -> DataFrame:
    """Adds `bin`, `worker` and `valid_from` of the map version in force at each record's time.

    A history counted to be small is broadcast: the records are not shuffled at all. A longer one
    is merged with the records in one ordered pass per bin, safe for hot bins. Records without a bin or a
    time, and those whose bin the history does not know, are dropped either way.
    """
    if _is_short(history):
        intervals = F.broadcast(history.withColumnRenamed("bin", "_bin"))
        in_force = (
            (F.col("bin") == F.col("_bin"))
            & F.col(time).isNotNull()
            & (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col(time)))
            & (F.col("valid_to").isNull() | (F.col(time) < F.col("valid_to")))
        )
        return records.withColumn("bin", bin_of).join(intervals, in_force, "inner").drop("_bin", "valid_to")
    return _distribute_ordered(records, bin_of, time, history)


def _is_short(history: DataFrame) -> bool:
    per_bin = history.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    found = per_bin.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    return (found.total or 0) <= BROADCAST_INTERVALS and (found.most or 0) <= BROADCAST_INTERVALS_PER_BIN


def _distribute_ordered(records, bin_of, time, history):
    columns = records.columns
    rows = records.select(
        bin_of.alias("bin"),
        F.col(time).alias("_at"),
        F.lit(1).alias("_tag"),
        F.xxhash64(*columns).alias("_spread"),
        F.struct(*columns).alias("_record"),
    )
    version_type = history.select(F.struct("worker", "valid_from").alias("v")).schema["v"].dataType
    versions = history.select(
        "bin",
        F.col("valid_from").alias("_at"),
        F.lit(0).alias("_tag"),
        F.lit(0).cast("bigint").alias("_spread"),
        F.lit(None).cast(rows.schema["_record"].dataType).alias("_record"),
        F.struct("worker", "valid_from").alias("_version"),
    )
    merged = rows.withColumn("_version", F.lit(None).cast(version_type)).unionByName(versions)
    found = running(
        merged.where("bin IS NOT NULL AND (_tag = 0 OR _at IS NOT NULL)"), ["bin"], ["_at", "_tag", "_spread"],
        latest={"_found": F.col("_version")},
    )
    return found.where("_tag = 1 AND _found IS NOT NULL").select(
        *[F.col(f"_record.{c}").alias(c) for c in columns],
        "bin",
        F.col("_found.worker").alias("worker"),
        F.col("_found.valid_from").alias("valid_from"),
    )


def bin_load(routed: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys per (worker, bin): the skew report.

    Rows are counted per key first; that count is what gets shuffled and summed per bin.
    """
    per_key = routed.groupBy("worker", "bin", key).agg(F.count(F.lit(1)).alias("_rows"))
    return per_key.groupBy("worker", "bin").agg(
        F.sum("_rows").alias("rows"), F.count(F.lit(1)).alias("keys")
    )


def moved_bins(history: DataFrame, routed: DataFrame) -> DataFrame:
    """Bins that changed worker between versions: (ts, bin, old_worker, new_worker, rows).

    `rows` is what the bin held before the change. Records are counted per interval and the counts
    are accumulated, so no record meets more than its own interval. The counts are written once, as running sums
    in slices read their input several times and records would be routed anew each time.
    """
    held = reusable(routed.groupBy("bin", "valid_from").agg(F.count(F.lit(1)).alias("_rows")))
    h = history.select("bin", "worker", "valid_from")
    held = held.select(F.col("bin").alias("_b"), F.col("valid_from").alias("_v"), "_rows")
    counted = h.join(
        held, (F.col("bin") == F.col("_b")) & F.col("valid_from").eqNullSafe(F.col("_v")), "left"
    ).select("bin", "worker", "valid_from", F.coalesce("_rows", F.lit(0)).alias("_rows"))
    steps = running(
        counted,
        ["bin"],
        ["valid_from"],
        sums={"_held": F.col("_rows")},
        previous={"old_worker": F.col("worker")},
    )
    return steps.where("old_worker IS NOT NULL AND old_worker != worker").select(
        F.col("valid_from").alias("ts"),
        "bin",
        "old_worker",
        F.col("worker").alias("new_worker"),
        (F.col("_held") - F.col("_rows")).alias("rows"),
    )
