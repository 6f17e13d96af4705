"""Running a streaming plan over everything that is there, and closing what is still open."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession

from bidflow.operators.sizing import scanned_bytes, scratch_folder

_STATE = "spark.sql.streaming.stateStore"
#: Settings of the streams that are run here.
CONF = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Counting the rows of a store costs a read for every write.
    f"{_STATE}.rocksdb.trackTotalNumberOfRows": "false",
    # Else every open store reserves about 70 MB of disk for a log.
    f"{_STATE}.rocksdb.allowFAllocate": "false",
    # Blocks are compressed one by one; stores are read and written in order, not by single rows.
    f"{_STATE}.rocksdb.compression": "zstd",
    f"{_STATE}.rocksdb.blockSizeKB": "64",
    # A store is in the checkpoint when its task ends. Else its local copy stays for a minute or more, also after the query.
    f"{_STATE}.unloadOnCommit": "true",
    # Shuffle files go when a trigger is done, not when the driver happens to collect its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: A run takes about so many bytes of input, where its plan can be run for some keys at a time.
RUN_BYTES_CONF = "spark.bidflow.streamRunBytes"
RUN_BYTES = 512 << 20
#: The time of the row that ends a stream, in microseconds: about the year 287000. It leaves room below the
#: largest timestamp for windows that are computed from it.
END_OF_TIME_US = 9_000_000_000_000_000_000


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet folder (or file) as a stream, with the schema its files have.

    `files_per_trigger` is for logs whose files are in time order: files read later than their time
    are behind the watermark. The path is given as a pattern matching only itself, because a plain
    path has to be a folder.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_table(
    spark: SparkSession, build: Callable[[DataFrame], DataFrame], name: str, flush: bool = True
) -> tuple[DataFrame, str]:
    """Runs `build(end)` over all available input; returns the written rows and the checkpoint.

    `end` is a stream (time TIMESTAMP) that stays empty while the input is read. Then one row at
    the end of time arrives in it: plans that union it in see their watermark pass everything, so
    open windows close and pending timers fire. Input is never late because of it.
    """
    folder = scratch_folder(spark, name)
    end_path, out_path, checkpoint = f"{folder}/end", f"{folder}/out", f"{folder}/checkpoint"
    marker = spark.sql(f"SELECT timestamp_micros({END_OF_TIME_US}) AS time")
    marker.limit(0).write.parquet(end_path)
    end = spark.readStream.schema(marker.schema).parquet(end_path)

    before = {name: spark.conf.get(name, None) for name in CONF}
    try:
        for name, value in CONF.items():
            spark.conf.set(name, value)
        plan = build(end)
        _run_available(plan, out_path, checkpoint)
        if flush:
            marker.write.mode("append").parquet(end_path)
            _run_available(plan, out_path, checkpoint)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(plan.schema).parquet(out_path), checkpoint


def run_count(*inputs: DataFrame) -> int:
    """Runs for `run_in_parts`, by the bytes of the files below these tables."""
    most = int(inputs[0].sparkSession.conf.get(RUN_BYTES_CONF, str(RUN_BYTES)))
    return max(1, -(-sum(scanned_bytes(df) for df in inputs) // most))


def run_in_parts(spark: SparkSession, build: Callable[[DataFrame, int], DataFrame], name: str, parts: int) -> tuple[DataFrame, str]:
    """`run_to_table` over `build(end, part)` for one part after another: the rows of all, and the last checkpoint.

    An input in no order of time is in state as a whole before anything closes. `build` takes the keys of a part from
    all its input, so only their state is on disk together: a part's checkpoint goes before the next part begins.
    """
    found, checkpoint = [], None
    for part in range(parts):
        if checkpoint:
            done = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
        rows, checkpoint = run_to_table(spark, partial(build, part=part), name)
        found.append(rows)
    return reduce(DataFrame.unionByName, found), checkpoint


def _run_available(plan: DataFrame, out_path: str, checkpoint: str) -> None:
    query = (
        plan.writeStream.format("parquet").outputMode("append")
        .option("path", out_path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def scan_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """All entries of one state variable of a stopped or running query."""
    return (
        spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
    )
