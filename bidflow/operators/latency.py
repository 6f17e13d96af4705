"""Latency analytics: distributions, quantile timelines, incidents and experiment parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bidflow.functions.scalars import histogram_bucket
from bidflow.operators.ordered import running
from bidflow.operators.sizing import is_small, materialize, reusable
from bidflow.operators.skew import balanced_join
from bidflow.sources.logs import QUANTILE_COLUMNS, param_type, run_params

# Quantile levels of a timeline as parts per thousand, and the table's CCDF levels.
LEVELS = dict(zip(QUANTILE_COLUMNS, [250, 500, 750, 950, 990, 999, 1000]))
TABLE_LEVELS = {"p90": 0.1, "p99": 0.01, "p999": 0.001}
BASELINE_SHARE = 0.7


def ccdf(samples: DataFrame, run: str, value: str) -> DataFrame:
    """Bucketed counts with the share of samples at or above each bucket: (run, bucket, share, samples).

    After grouping a run has at most 1024 buckets (64 powers of two times 16), so the window is small.
    """
    counts = samples.groupBy(F.col(run).alias("run"), histogram_bucket(value).alias("bucket")).agg(
        F.count(F.lit(1)).alias("samples")
    )
    whole = Window.partitionBy("run")
    at_or_above = whole.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("samples").over(at_or_above) / F.sum("samples").over(whole)
    return counts.select("run", "bucket", share.alias("share"), "samples")


def count_ccdf(rows: DataFrame, run: str, batch: Column) -> DataFrame:
    """The same over the number of rows per batch."""
    sizes = rows.groupBy(F.col(run).alias("_run"), batch.alias("_batch")).agg(F.count(F.lit(1)).alias("_size"))
    return ccdf(sizes, "_run", "_size")


def quantile_timeline(samples: DataFrame, run: str, bucket: Column, value: str) -> DataFrame:
    """Seven rank-exact quantiles per (run, time bucket): the value of rank ceil(p * n).

    Equal values are counted first; a running count over the distinct values then finds each rank,
    in range slices when a bucket is large, so no bucket has to fit into one task.
    """
    counts = reusable(
        samples.groupBy(F.col(run).alias("run"), bucket.alias("bucket"), F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running(counts, ["run", "bucket"], ["value"], sums={"_upto": F.col("_n")})
    totals = counts.groupBy("run", "bucket").agg(F.sum("_n").alias("_total")).select(
        F.col("run").alias("_run"), F.col("bucket").alias("_bucket"), "_total"
    )
    joined = balanced_join(ranked, totals, ["run", "bucket"], ["_run", "_bucket"])
    reached = {
        name: F.min(F.when(F.col("_upto") >= F.expr(f"(_total * {level} + 999) div 1000"), F.col("value")))
        for name, level in LEVELS.items()
    }
    return joined.groupBy("run", "bucket").agg(*[v.alias(k) for k, v in reached.items()])


def ccdf_table(ccdf_rows: DataFrame) -> DataFrame:
    """Per run the first bucket whose share is at most 0.1, 0.01 and 0.001, and the last bucket."""
    return ccdf_rows.groupBy("run").agg(
        *[F.min(F.when(F.col("share") <= share, F.col("bucket"))).alias(name) for name, share in TABLE_LEVELS.items()],
        F.max("bucket").alias("pmax"),
    )


def baseline(ccdf_rows: DataFrame, share: float = BASELINE_SHARE) -> DataFrame:
    """Per run the first bucket whose share is at most `share`."""
    return ccdf_rows.where(F.col("share") <= share).groupBy("run").agg(F.min("bucket").alias("baseline"))


def incident_breakdown(
    timeline: DataFrame, triggers: DataFrame, base: DataFrame, reported: DataFrame | None = None
) -> DataFrame:
    """Slow stretches that follow a trigger, per run: total duration and maxima of all quantiles.

    timeline  (run, time BIGINT, seven quantiles), one row per time bucket
    triggers  (run, time BIGINT)
    base      (run, baseline); a bucket is slow when its p50 exceeds twice the baseline
    reported  (run, duration), summed and maximized next to the observed duration

    A trigger is eligible at the first bucket one interval after it, one trigger is taken per
    bucket, and a slow bucket counts while no bucket since the last taken trigger was not slow.
    All tables have one row per time bucket or less: raw samples are never touched here. Larger inputs are written
    between the ordered passes, since each pass in slices reads its input several times.
    """
    large = not is_small(timeline, triggers, base)

    def once(df: DataFrame) -> DataFrame:
        return materialize(df) if large else df

    timeline = once(timeline)
    rows = running(timeline, ["run"], ["time"], rank="_rank", previous={"_prev": F.col("time")})
    rows = once(rows.withColumn("_r", F.col("_rank") - 1).drop("_rank"))
    interval = rows.where("_r = 1").select(F.col("run").alias("_irun"), (F.col("time") - F.col("_prev")).alias("_interval"))

    # First bucket at or after trigger time + interval: one ordered pass over both tables.
    due = balanced_join(triggers.select("run", "time"), interval, "run", "_irun").select(
        "run", (F.col("time") + F.col("_interval")).alias("_at"), F.lit(0).alias("_tag"), F.lit(None).cast("bigint").alias("_r")
    )
    marks = once(due.unionByName(rows.select("run", F.col("time").alias("_at"), F.lit(1).alias("_tag"), "_r")))
    eligible = (
        running(marks, ["run"], ["_at", "_tag"], following={"_elig": F.col("_r")})
        .where("_tag = 0 AND _elig IS NOT NULL")
        .withColumn("_elig", F.greatest("_elig", F.lit(1).cast("bigint")))
    )
    # Equal triggers share (_at, _elig), so any order among them gives the same set of rows.
    numbered = once(running(once(eligible.select("run", "_elig", "_at")), ["run"], ["_at"], rank="_j"))
    taken = running(
        numbered, ["run"], ["_j"], maxima={"_ahead": F.col("_elig") - F.col("_j")}
    ).select(F.col("run").alias("_trun"), (F.col("_j") + F.col("_ahead")).alias("_tr"))

    with_taken = rows.join(taken, (F.col("run") == F.col("_trun")) & (F.col("_r") == F.col("_tr")), "left")
    marked = balanced_join(
        with_taken, base.select(F.col("run").alias("_brun"), "baseline"), "run", "_brun"
    ).withColumn("_slow", F.col("p50") > 2 * F.col("baseline"))
    state = running(
        once(marked),
        ["run"],
        ["time"],
        maxima={
            "_last_taken": F.when(F.col("_tr").isNotNull(), F.col("_r")),
            "_last_calm": F.when(~F.col("_slow"), F.col("_r")),
        },
    )
    counted = state.where("_slow AND _last_taken > coalesce(_last_calm, -1)")
    observed = counted.groupBy("run").agg(
        F.sum(F.col("time") - F.col("_prev")).alias("duration"),
        *[F.max(q).alias(f"max_{q}") for q in QUANTILE_COLUMNS],
    )
    if reported is None:
        return observed
    told = reported.groupBy("run").agg(
        F.sum("duration").alias("reported_sum"), F.max("duration").alias("reported_max")
    )
    zero = F.lit(0).cast("bigint")
    # One row per run on both sides; a run shows up if it has either kind of duration.
    tagged = observed.select(
        "*", zero.alias("reported_sum"), zero.alias("reported_max")
    ).unionByName(
        told.select("run", zero.alias("duration"), *[zero.alias(f"max_{q}") for q in QUANTILE_COLUMNS],
                    "reported_sum", "reported_max")
    )
    return (
        tagged.groupBy("run")
        .agg(*[F.max(c).alias(c) for c in tagged.columns if c != "run"])
        .where("duration > 0 OR reported_sum > 0")
    )


# -- experiments ---------------------------------------------------------------------------------


def experiment_params(runs: DataFrame) -> DataFrame:
    """Distinct values of every parameter: (param, value, type, n_values, is_constant).

    Values come as rows, not as one array per parameter, so their number is not limited.
    """
    values = reusable(
        run_params(runs.select("run").distinct())
        .select(F.explode("params").alias("param", "value"))
        .distinct()
    )
    counts = values.groupBy(F.col("param").alias("_param")).agg(F.count(F.lit(1)).alias("n_values"))
    return balanced_join(values, counts, "param", "_param").select(
        "param", "value", param_type("value").alias("type"), "n_values", (F.col("n_values") == 1).alias("is_constant")
    )


def experiment_filter(runs: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Runs whose parameters include all of `wanted`."""
    with_params = run_params(runs)
    for name, value in wanted.items():
        with_params = with_params.where(F.col("params")[name] == value)
    return with_params.drop("params")


def pivot_groups(
    rows: DataFrame, primary: str, secondary: str, secondary_values: list[str], value: Column
) -> DataFrame:
    """One row per primary value, one column per secondary value."""
    return rows.groupBy(primary).pivot(secondary, secondary_values).agg(value)
