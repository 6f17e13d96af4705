"""Text logs and the event log: control logs, result logs, capture and replay."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from bidflow.operators.skew import balanced_join

# The tags of result-log lines, and the letters of control-log lines.
CCDF_TAGS = ["latency_ccdf", "count_ccdf"]
MEMORY_TAG = "statm_RSS"
TIMELINE_TAG = "summary_timeline"
REPORTED_TAG = "migration_done"
TRIGGER_TAG = "control_time"
QUANTILE_COLUMNS = ["p25", "p50", "p75", "p95", "p99", "p999", "pmax"]


# -- event log -----------------------------------------------------------------------------------


def capture(events: DataFrame, path: str) -> None:
    """Writes a bounded event table to a log folder that any number of queries can replay."""
    events.write.mode("append").parquet(path)


def capture_stream(events: DataFrame, path: str, checkpoint: str):
    """Appends a stream to a log folder; returns the running query."""
    return (
        events.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def replay(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replay_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None):
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


# -- control logs --------------------------------------------------------------------------------


def read_control_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_control_lines(spark.read.text(path))


def parse_control_lines(lines: DataFrame) -> DataFrame:
    """`M ts w0 w1 ...` (full map) and `D ts bin worker ...` (moves) as one row per assignment.

    `msg` numbers the messages of a line: a map is one message, every move is one. All messages of
    a time share a sequence number; the log has one line per time, so the time serves as one.
    A move line without moves has no rows. A line that starts with any other letter, or a move without
    its worker, is an error.
    """
    # A column of its own, so that a line is split once.
    words = lines.where(F.length(F.trim("value")) > 0).select(F.split(F.trim("value"), r"\s+").alias("w"))
    parsed = words.select(
        F.col("w")[0].alias("kind"),
        F.col("w")[1].cast("bigint").alias("ts"),
        F.transform(F.slice("w", 3, F.size("w")), lambda w: w.cast("bigint")).alias("args"),
    )
    checked = parsed.withColumn(
        "kind",
        F.when(~F.col("kind").isin("M", "D"), F.raise_error(F.concat(F.lit("unknown control line: "), F.col("kind"))))
        .when((F.col("kind") == "D") & (F.size("args") % 2 == 1), F.raise_error(F.lit("a move without its worker")))
        .otherwise(F.col("kind")),
    )
    size = F.size("args")
    map_rows = F.transform(
        "args", lambda w, i: F.struct(i.cast("bigint").alias("pos"), i.cast("bigint").alias("bin"), w.alias("worker"))
    )
    move_rows = F.transform(
        F.when(size >= 2, F.sequence(F.lit(0), (size / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            i.cast("bigint").alias("pos"),
            F.get("args", 2 * i).alias("bin"),
            F.get("args", 2 * i + 1).alias("worker"),
        ),
    )
    is_map = F.col("kind") == "M"
    return checked.select(
        "ts",
        F.col("ts").alias("sequence"),
        F.when(is_map, F.lit(1)).otherwise(size / 2).cast("bigint").alias("count"),
        "kind",
        F.explode(F.when(is_map, map_rows).otherwise(move_rows)).alias("e"),
    ).select(
        "ts",
        "sequence",
        "count",
        F.when(F.col("kind") == "M", F.lit(0)).otherwise(F.col("e.pos")).cast("bigint").alias("msg"),
        "kind",
        "e.pos",
        "e.bin",
        "e.worker",
    )


# -- result logs ---------------------------------------------------------------------------------


def read_result_logs(spark: SparkSession, root: str, file_name: str = "stdout.0") -> DataFrame:
    """Lines of `root/<run>/<file_name>` for the runs that have a `done` marker: (run, value)."""
    # Paths are URL-encoded, but with literal plus signs.
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    lines = spark.read.text(f"{root}/*/{file_name}").select(
        F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))).alias("run"), "value"
    )
    return finished_runs(lines, done_runs(spark, root))


def done_runs(spark: SparkSession, root: str) -> DataFrame:
    """Names of the runs with a `done` marker: a listing, as the markers are empty files no reader returns."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/done")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    names = [status.getPath().getParent().getName() for status in found]
    return spark.createDataFrame(pa.table({"run": pa.array(names, pa.string())}))


def finished_runs(lines: DataFrame, done: DataFrame) -> DataFrame:
    """Keeps lines of finished runs. Distinct markers make the join a filter; a long run is spread."""
    finished = done.select(F.col("run").alias("_finished")).distinct()
    return balanced_join(lines, finished, "run", "_finished").drop("_finished")


def parse_result_lines(lines: DataFrame) -> DataFrame:
    """(run, value) lines as (run, tag, fields): tab-separated, tag in the first column."""
    words = F.split(F.trim("value"), "\t")
    return lines.select("run", words[0].alias("tag"), F.slice(words, 2, F.size(words)).alias("fields"))


def ccdf_lines(parsed: DataFrame, tag: str = CCDF_TAGS[0]) -> DataFrame:
    return parsed.where(F.col("tag") == tag).select(
        "run",
        F.get("fields", 0).cast("bigint").alias("value"),
        F.get("fields", 1).cast("double").alias("share"),
        F.get("fields", 2).cast("bigint").alias("samples"),
    )


def memory_timeline(parsed: DataFrame) -> DataFrame:
    """Resident memory over time: (run, seconds, bytes)."""
    return parsed.where(F.col("tag") == MEMORY_TAG).select(
        "run",
        (F.get("fields", 0).cast("bigint") / F.lit(1e9)).alias("seconds"),
        F.get("fields", 1).cast("bigint").alias("bytes"),
    )


def timeline_lines(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("tag") == TIMELINE_TAG).select(
        "run",
        F.get("fields", 0).cast("bigint").alias("time"),
        *[F.get("fields", i + 1).cast("bigint").alias(q) for i, q in enumerate(QUANTILE_COLUMNS)],
    )


def reported_lines(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("tag") == REPORTED_TAG).select(
        "run",
        F.get("fields", 0).cast("bigint").alias("time"),
        F.get("fields", 1).cast("bigint").alias("duration"),
    )


def trigger_lines(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("tag") == TRIGGER_TAG).select("run", F.get("fields", 0).cast("bigint").alias("time"))


# -- run names -----------------------------------------------------------------------------------


def run_params(runs: DataFrame) -> DataFrame:
    """Adds `params`, the map in a run name like `rate=100+native=True`.

    Values stay text. `param_type` tells what a value stands for.
    """
    return runs.withColumn("params", F.str_to_map("run", F.lit("[+]"), F.lit("=")))


def param_type(value: str):
    text = F.col(value)
    return (
        F.when(text.rlike("^[0-9]+$"), "BIGINT").when(text.isin("True", "False"), "BOOLEAN").otherwise("STRING")
    )
