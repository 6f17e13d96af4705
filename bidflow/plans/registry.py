"""Every query by name, over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from bidflow.functions import scalars
from bidflow.operators import changelog, joins, latency, routing
from bidflow.operators.ordered import running
from bidflow.operators.sizing import scratch_folder
from bidflow.plans import auctions as q
from bidflow.plans import words as w
from bidflow.sources import logs, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters on the driver's tables, whose times are days (orders) and minutes (events) apart.
HOUR = 3600
DAY = 24 * HOUR
Q5_SLICES = 24
Q8_WINDOW = 90 * DAY
BIN_SHIFT = 3
WORKERS = 4
PEERS = 4


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _auctions_bids(spark, d):
    return tables.auctions(spark, d), tables.bids(spark, d)


def _closed(spark, d):
    return q.closed_auctions(*_auctions_bids(spark, d))


def _auctions_people(spark, d):
    return tables.auctions(spark, d), tables.people(spark, d)


def _tagged(spark, d):
    return tables.tagged_events(tables.people(spark, d), *_auctions_bids(spark, d))


# -- sources and sinks ---------------------------------------------------------------------------


def _branch_totals(people, auctions, bids):
    def totals(df, name, number):
        return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(number).alias("total")).select(
            F.lit(name).alias("branch"), "rows", "total"
        )

    return (
        totals(people, "people", "id")
        .unionByName(totals(auctions, "auctions", "seller"))
        .unionByName(totals(bids, "bids", "price"))
    )


@query
def demux_events(spark, d):
    return _branch_totals(*tables.demux(_tagged(spark, d)))


@query
def event_log(spark, d):
    """Writes all events to a log once and replays it into three branches."""
    path = scratch_folder(spark, "event-log")
    logs.capture(_tagged(spark, d), path)
    return _branch_totals(*tables.demux(logs.replay(spark, path)))


@query
def auction_views(spark, d):
    """The three record views in one outer shape."""
    people, auctions, bids = tables.people(spark, d), *_auctions_bids(spark, d)
    return (
        people.select(F.lit("person").alias("kind"), "id", F.col("state").alias("label"), "date_time",
                      F.lit(None).cast("bigint").alias("amount"))
        .unionByName(auctions.select(F.lit("auction").alias("kind"), "id", F.col("category").cast("string").alias("label"),
                                     F.col("expires").alias("date_time"), F.col("reserve").alias("amount")))
        .unionByName(bids.select(F.lit("bid").alias("kind"), F.col("auction").alias("id"),
                                 F.col("bidder").cast("string").alias("label"), "date_time", F.col("price").alias("amount")))
    )


def control_lines(clicks: DataFrame) -> DataFrame:
    """A control log that grows with the events: every sign-up sets a full map, every error moves two bins."""
    e = clicks.withColumn("t", scalars.micros_of("date_time"))
    whole_map = F.concat_ws(" ", *[((F.col("auction") + b) % WORKERS).cast("string") for b in range(1 << BIN_SHIFT)])
    moves = F.expr(
        "concat_ws(' ', CAST(bidder % 8 AS STRING), CAST(auction % 4 AS STRING), "
        "CAST((bidder div 8) % 8 AS STRING), CAST((auction div 4) % 4 AS STRING))"
    )
    maps = e.where("event_type = 'signup'").select(
        F.concat_ws(" ", F.lit("M"), F.col("t").cast("string"), whole_map).alias("value")
    )
    errors = e.where("event_type = 'error'").select(
        F.concat_ws(" ", F.lit("D"), F.col("t").cast("string"), moves).alias("value")
    )
    return maps.unionByName(errors)


@query
def control_log_scan(spark, d):
    return logs.parse_control_lines(control_lines(tables.clicks(spark, d)))


def result_lines(spark, d) -> DataFrame:
    """A result log that grows with the events: one line per event, its tag chosen by the type."""
    run = F.concat(
        F.lit("user="), F.col("bidder").cast("string"), F.lit("+type="), F.col("event_type"),
        F.lit("+even="), F.when(F.col("bidder") % 2 == 0, "True").otherwise("False"),
    )
    e = tables.clicks(spark, d).withColumns({"run": run, "ns": scalars.micros_of("date_time") * 1000})
    value = F.expr(
        "CASE event_type"
        " WHEN 'click' THEN concat_ws('\\t', 'latency_ccdf', price, price / 100, auction)"
        " WHEN 'view' THEN concat_ws('\\t', 'statm_RSS', ns, price * 4096)"
        " WHEN 'purchase' THEN concat_ws('\\t', 'migration_done', ns, price)"
        " WHEN 'signup' THEN concat_ws('\\t', 'control_time', ns)"
        " ELSE concat_ws('\\t', 'summary_timeline', ns, price, price + 1, price + 2, price + 3, price + 4,"
        " price + 5, price + 6) END"
    )
    lines = e.select("run", value.alias("value"))
    done = e.where("price > 20000").select("run")
    return logs.finished_runs(lines, done)


@query
def result_log_scan(spark, d):
    parsed = logs.run_params(logs.parse_result_lines(result_lines(spark, d)))
    return parsed.select(
        "run",
        "tag",
        F.size("fields").cast("bigint").alias("n_fields"),
        F.get("fields", 0).cast("bigint").alias("first_field"),
        F.element_at("fields", -1).cast("bigint").alias("last_field"),
        F.col("params")["user"].cast("bigint").alias("user"),
        (F.col("params")["even"] == "True").alias("even"),
    )


# -- projections and scalars ---------------------------------------------------------------------


@query
def q0(spark, d):
    return q.q0(tables.table(spark, d, "events"))


@query
def q1(spark, d):
    return q.q1(tables.bids(spark, d))


@query
def q2(spark, d):
    return q.q2(tables.bids(spark, d))


@query
def event_time_key(spark, d):
    return _tagged(spark, d).select(
        "type", scalars.event_time().alias("time"), scalars.event_key().alias("key")
    )


@query
def slot_end(spark, d):
    timed = tables.clicks(spark, d).withColumn("us", scalars.micros_of("date_time"))
    ends = timed.withColumn("end_us", scalars.slot_end("us", HOUR * 1_000_000))
    return ends.select("event_id", "end_us", scalars.ntz_of("end_us").alias("slot_end"))


@query
def time_shift(spark, d):
    opened = changelog.as_changelog(tables.auctions(spark, d).select("id", "date_time", "expires"), F.col("date_time"))
    return changelog.shift_time(opened, F.col("expires")).select("id", "time", "diff")


@query
def bin_of_key(spark, d):
    return tables.table(spark, d, "events").select(
        "event_id", "user_id", scalars.bin_of_dense("user_id", BIN_SHIFT).alias("bin")
    )


@query
def histogram_bucket(spark, d):
    return tables.clicks(spark, d).select(
        "event_id", F.col("price").alias("latency"), scalars.histogram_bucket("price").alias("bucket")
    )


# -- joins ---------------------------------------------------------------------------------------


@query
def q3(spark, d):
    return q.q3(*_auctions_people(spark, d))


@query
def q3_latest(spark, d):
    return q.q3_latest(*_auctions_people(spark, d))


@query
def q3_semijoin(spark, d):
    return q.q3_semijoin(*_auctions_people(spark, d))


@query
def q3_semijoin_as_written(spark, d):
    return q.q3_semijoin(*_auctions_people(spark, d), key="id")


@query
def latest_match_join(spark, d):
    """Clicks of a user with the user's latest sign-up, else with the next one."""
    e = tables.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    left = e.where("event_type = 'signup'").drop("event_type")
    right = e.where("event_type = 'click'").drop("event_type")
    return joins.latest_match_join(left, right, "user_id", "ts", "event_id", "event_id").select(
        "user_id", "left_event_id", "right_event_id", "left_ts", "right_ts"
    )


@query
def closed_auctions(spark, d):
    return _closed(spark, d)


@query
def closed_auctions_no_lower_bound(spark, d):
    return q.closed_auctions(*_auctions_bids(spark, d), lower_bound=False)


@query
def q8(spark, d):
    return q.q8(*_auctions_people(spark, d), window_seconds=Q8_WINDOW)


@query
def q8_as_written(spark, d):
    return q.q8_as_written(tables.auctions(spark, d), window_seconds=Q8_WINDOW)


@query
def q8_changelog(spark, d):
    return q.q8_changelog(*_auctions_people(spark, d), window_seconds=Q8_WINDOW)


def fixture_history(spark) -> DataFrame:
    """Fixed control input: a full map, two moves ten days later, another full map ten days later."""
    bins = range(1 << BIN_SHIFT)
    rows = [f"('2024-01-01', 0, 1, 0, 'M', {b}, {b}, {b % WORKERS})" for b in bins]
    rows += ["('2024-01-10', 1, 2, 0, 'D', 0, 1, 0)", "('2024-01-10', 1, 2, 1, 'D', 1, 5, 2)"]
    rows += [f"('2024-01-20', 2, 1, 0, 'M', {b}, {b}, {(b + 1) % WORKERS})" for b in bins]
    control = spark.sql(
        "SELECT CAST(day AS TIMESTAMP_NTZ) AS ts, CAST(sequence AS BIGINT) AS sequence, CAST(count AS BIGINT) AS count,"
        " CAST(msg AS BIGINT) AS msg, kind, CAST(pos AS BIGINT) AS pos, CAST(bin AS BIGINT) AS bin,"
        f" CAST(worker AS BIGINT) AS worker FROM VALUES {', '.join(rows)}"
        " AS t(day, sequence, count, msg, kind, pos, bin, worker)"
    )
    return routing.control_history(control, routing.initial_map(spark, 1 << BIN_SHIFT, WORKERS))


def _routed_events(spark, d):
    events = tables.table(spark, d, "events")
    return routing.distribute(
        events, scalars.bin_of_dense("user_id", BIN_SHIFT), "ts", fixture_history(spark)
    )


def _routed_clicks(spark, d):
    return routing.distribute(
        tables.clicks(spark, d), scalars.bin_of_dense("auction", BIN_SHIFT), "date_time", fixture_history(spark)
    )


@query
def distribute(spark, d):
    return _routed_events(spark, d).select("event_id", "ts", "user_id", "bin", "worker")


@query
def q0_routed(spark, d):
    return _routed_events(spark, d).select("worker", F.col("user_id").alias("key"), "event_id", "event_type", "value")


@query
def q1_routed(spark, d):
    routed = _routed_clicks(spark, d)
    return routed.select(
        "worker", F.col("auction").alias("key"), "event_id", scalars.to_euro_cents("price").alias("price")
    )


@query
def q2_routed(spark, d):
    """Bids of q2, routed by their auction."""
    bids = tables.bids(spark, d)
    routed = routing.distribute(bids, scalars.bin_of_dense("auction", BIN_SHIFT), "date_time", fixture_history(spark))
    return routed.where(q.q2_auctions()).select("worker", F.col("auction").alias("key"), "price")


# -- aggregations --------------------------------------------------------------------------------


@query
def q4(spark, d):
    return q.q4(_closed(spark, d))


@query
def q4_sum_count(spark, d):
    return q.q4_sum_count(_closed(spark, d))


@query
def q5(spark, d):
    return q.q5(tables.clicks(spark, d), Q5_SLICES, HOUR)


@query
def q5_local(spark, d):
    return q.q5_local(tables.clicks(spark, d), PEERS, Q5_SLICES, HOUR)


@query
def q7(spark, d):
    return q.q7(tables.clicks(spark, d), HOUR)


@query
def q7_argmax(spark, d):
    return q.q7_argmax(tables.clicks(spark, d), HOUR)


@query
def word_count(spark, d):
    return w.word_count(tables.words(spark, d))


@query
def multiset_top1(spark, d):
    e = tables.clicks(spark, d).select("bidder", "price", "event_id")
    return changelog.top1(e, ["bidder"], [-F.col("price"), F.col("event_id")])


def _hourly_changes(spark, d):
    """One insertion in an event's hour, one deletion in the hour reached 20 minutes later."""
    e = tables.clicks(spark, d)
    later = F.expr("date_trunc('HOUR', date_time + INTERVAL '20' MINUTE)").cast("timestamp_ntz")
    added = changelog.as_changelog(e, F.expr("date_trunc('HOUR', date_time)").cast("timestamp_ntz"))
    gone = changelog.negate(changelog.as_changelog(e, later))
    return changelog.concat(added, gone).select("auction", "time", "diff")


@query
def consolidate(spark, d):
    return changelog.consolidate(_hourly_changes(spark, d))


@query
def bin_load(spark, d):
    return routing.bin_load(_routed_events(spark, d), "user_id")


# -- running values ------------------------------------------------------------------------------


@query
def q4_running(spark, d):
    return q.q4_running(_closed(spark, d))


@query
def q6(spark, d):
    return q.q6(_closed(spark, d))


@query
def q6_seller(spark, d):
    return q.q6_seller(_closed(spark, d))


@query
def word_count_running(spark, d):
    return w.word_count_running(tables.words(spark, d), ["ts", "event_id"])


def _log_history(spark, d):
    control = logs.parse_control_lines(control_lines(tables.clicks(spark, d)))
    return routing.control_history(control, routing.initial_map(spark, 1 << BIN_SHIFT, WORKERS))


@query
def control_history(spark, d):
    return _log_history(spark, d)


@query
def control_violations(spark, d):
    """Two bids of one auction as two messages of one time: their prices as sequence numbers differ."""
    control = tables.clicks(spark, d).selectExpr(
        "date_time AS _t", "timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', date_time) AS ts",
        "price div 10000 AS sequence", "event_id AS msg", "1 + auction % 20 AS count",
    )
    return routing.control_violations(control)


@query
def moved_bins(spark, d):
    history = _log_history(spark, d)
    events = tables.table(spark, d, "events").select("event_id", "user_id", scalars.micros_of("ts").alias("us"))
    routed = routing.distribute(events, scalars.bin_of_dense("user_id", BIN_SHIFT), "us", history)
    return routing.moved_bins(history, routed)


@query
def event_timers(spark, d):
    """Every event delivered `price` seconds after its time, in due order per user: its due time and position."""
    due = tables.clicks(spark, d).select(
        F.col("bidder").alias("user_id"), "event_id", (scalars.micros_of("date_time") + F.col("price") * 1_000_000).alias("due_us")
    )
    return running(due, ["user_id"], ["due_us", "event_id"], rank="position")


@query
def time_ordered(spark, d):
    e = tables.table(spark, d, "events").select("event_type", "ts", "event_id")
    return w.time_ordered(e, ["event_type"], ["ts", "event_id"])


# -- multisets -----------------------------------------------------------------------------------


def _signed(spark, d, of_auction):
    """All events as insertions keyed by auction or, as a second collection, by bidder."""
    e = tables.clicks(spark, d)
    key = F.col("auction" if of_auction else "bidder")
    return changelog.as_changelog(e, F.col("date_time")).select(key.alias("key"), "event_id", "diff")


@query
def multiset_concat(spark, d):
    """Events by auction, without those by bidder: what stays are events whose two keys differ, twice."""
    changes = changelog.concat(_signed(spark, d, True), changelog.negate(_signed(spark, d, False)))
    return changelog.consolidate(changes)


@query
def multiset_negate(spark, d):
    return changelog.negate(_signed(spark, d, True))


@query
def sliding_changelog(spark, d):
    counts = q.slot_counts(tables.clicks(spark, d), HOUR)
    return changelog.sliding_changelog(counts, Q5_SLICES, HOUR)


@query
def verify_equal(spark, d):
    """Word totals against totals in which purchases are missing: the words that differ."""
    words = tables.words(spark, d)
    without = words.join(
        tables.table(spark, d, "events").where("event_type = 'purchase'").select("event_id"), "event_id", "left_anti"
    )
    return changelog.verify_equal(words.select("key"), without.select("key"))


@query
def verify_word_counts(spark, d):
    """Two independent word counts agree: the last running total and the plain sum. Empty."""
    words = tables.words(spark, d)
    running_totals = w.word_count_running(words, ["ts", "event_id"])
    last = running_totals.groupBy("key").agg(F.max("total").alias("total"))
    return changelog.verify_equal(w.word_count(words), last)


# -- latency -------------------------------------------------------------------------------------


def _day_bucket():
    return F.expr("timestampdiff(DAY, TIMESTAMP_NTZ '1970-01-01 00:00:00', date_time)")


def _latencies(spark, d):
    return tables.clicks(spark, d).select(F.col("event_type").alias("run"), "date_time", F.col("price").alias("latency"), "auction")


@query
def latency_ccdf(spark, d):
    return latency.ccdf(_latencies(spark, d), "run", "latency")


@query
def count_ccdf(spark, d):
    return latency.count_ccdf(_latencies(spark, d), "run", F.window("date_time", "1 hour"))


@query
def latency_timeline(spark, d):
    return latency.quantile_timeline(_latencies(spark, d), "run", _day_bucket(), "latency")


@query
def memory_timeline(spark, d):
    return logs.memory_timeline(logs.parse_result_lines(result_lines(spark, d)))


@query
def ccdf_table(spark, d):
    return latency.ccdf_table(latency_ccdf(spark, d))


@query
def incident_breakdown(spark, d):
    """A run per user: every event is a latency sample, every sign-up a trigger, every purchase reports a duration."""
    run = F.concat(F.lit("user="), F.col("bidder").cast("string"))
    events = tables.clicks(spark, d).select(run.alias("run"), "event_type", "date_time", F.col("price").alias("latency"))
    timeline = latency.quantile_timeline(events, "run", _day_bucket(), "latency").withColumnRenamed("bucket", "time")
    base = latency.baseline(latency.ccdf(events, "run", "latency"))
    triggers = events.where("event_type = 'signup'").select("run", _day_bucket().cast("bigint").alias("time"))
    reported = events.where("event_type = 'purchase'").select("run", F.col("latency").alias("duration"))
    return latency.incident_breakdown(timeline, triggers, base, reported)


def _runs(spark, d):
    return result_lines(spark, d).select("run")


@query
def experiment_params(spark, d):
    return latency.experiment_params(_runs(spark, d))


@query
def experiment_filter(spark, d):
    return latency.experiment_filter(_runs(spark, d).distinct(), {"type": "click", "even": "True"})


@query
def pivot_groups(spark, d):
    e = tables.clicks(spark, d)
    kinds = ["click", "error", "purchase", "signup", "view"]
    return latency.pivot_groups(e, "bidder", "event_type", kinds, F.sum("price"))
