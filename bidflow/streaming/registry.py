"""Streaming forms over the driver's tables, run to completion and read back as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from bidflow.functions import scalars
from bidflow.operators.sizing import scratch_folder
from bidflow.plans import auctions as q
from bidflow.plans.registry import BIN_SHIFT, HOUR, Q5_SLICES, Q8_WINDOW, WORKERS, control_lines
from bidflow.sources import tables
from bidflow.sources.logs import capture, parse_control_lines, replay_stream
from bidflow.streaming import folds, queries as sq, routing, timers
from bidflow.streaming.runs import read_stream, run_count, run_in_parts, run_to_table, scan_state

STREAMS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def stream(fn):
    STREAMS[fn.__name__] = fn
    return fn


def _end_rows(end: DataFrame, like: DataFrame) -> DataFrame:
    """The end marker in the columns of another stream: its time in all times, -1 or null elsewhere."""
    def column(f):
        if f.dataType.simpleString() == "timestamp":
            return F.col("time").alias(f.name)
        filler = F.lit(-1) if f.dataType.simpleString() == "bigint" else F.lit(None)
        return filler.cast(f.dataType).alias(f.name)

    return end.select(*[column(f) for f in like.schema.fields])


class _Streams:
    """The auction model with its large tables read as streams."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    def _table(self, name):
        return read_stream(self.spark, f"{self.d}/{name}.parquet")

    def clicks(self):
        return sq.with_timestamps(tables.clicks_of(self._table("events")))

    def auctions(self):
        return sq.with_timestamps(tables.auctions_of(self._table("orders")))

    def bids(self):
        return sq.with_timestamps(tables.bids_of(self._table("lineitem")))

    def people(self):
        nation = tables.table(self.spark, self.d, "nation")
        return sq.with_timestamps(tables.people_of(self._table("customer"), nation))


def _with_end(df: DataFrame, end: DataFrame) -> DataFrame:
    return df.unionByName(_end_rows(end, df))


def _marked_end(df: DataFrame, end: DataFrame) -> DataFrame:
    """The same with a column that tells the marker from data."""
    return df.withColumn("_end", F.lit(False)).unionByName(_end_rows(end, df).withColumn("_end", F.lit(True)))


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@stream
def stream_q1(spark, d):
    return _ntz(run_to_table(spark, lambda end: q.q1(_Streams(spark, d).bids()), "stream-q1", flush=False)[0], "date_time")


@stream
def stream_q3(spark, d):
    s = _Streams(spark, d)
    return run_to_table(spark, lambda end: sq.q3(s.auctions(), s.people()), "stream-q3", flush=False)[0]


@stream
def stream_q5(spark, d):
    def build(end):
        return sq.q5(_with_end(_Streams(spark, d).clicks(), end), Q5_SLICES, HOUR)

    return _ntz(run_to_table(spark, build, "stream-q5")[0], "window_end")


@stream
def stream_q7(spark, d):
    def build(end):
        return sq.q7(_with_end(_Streams(spark, d).clicks(), end), HOUR)

    return _ntz(run_to_table(spark, build, "stream-q7")[0], "window_end")


@stream
def stream_q8(spark, d):
    s = _Streams(spark, d)
    return run_to_table(spark, lambda end: sq.q8(s.auctions(), s.people(), Q8_WINDOW), "stream-q8", flush=False)[0]


def _closed(spark, d):
    s = _Streams(spark, d)
    parts = run_count(tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem"))

    def build(end, part):
        auctions, bids = (df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part) for df, key in ((s.auctions(), "id"), (s.bids(), "auction")))
        # Auctions of these tables last 365 days.
        return sq.closed_auctions(_with_end(auctions, end), _with_end(bids, end), slot_seconds=365 * 86_400)

    return run_in_parts(spark, build, "closed-log", parts)


@stream
def stream_closed_auctions(spark, d):
    rows = _closed(spark, d)[0]
    return rows.select(
        "id", "seller", "category", "initial_bid", "reserve",
        scalars.ntz_of("opened_us").alias("date_time"), scalars.ntz_of("expires_us").alias("expires"),
        "bidder", "price", scalars.ntz_of("bid_us").alias("bid_time"),
    )


def _from_closed_log(spark, closed, plan, name):
    """Second stage: the closed-auction table is written once as a log and streamed from there."""
    path = scratch_folder(spark, f"{name}-log")
    capture(closed, path)

    def build(end):
        log = sq.closed_log(replay_stream(spark, path, StructType.fromDDL(sq.CLOSED)))
        return plan(_with_end(log, end))

    return run_to_table(spark, build, name)[0]


@stream
def stream_q4_running(spark, d):
    return _from_closed_log(spark, _closed(spark, d)[0], sq.q4_running, "stream-q4")


@stream
def stream_q6(spark, d):
    return _from_closed_log(spark, _closed(spark, d)[0], sq.q6, "stream-q6")


# -- stateful operators --------------------------------------------------------------------------


def _machine(spark, d):
    """A user's spending since the last sign-up: the state is removed by every sign-up."""

    def fold(user, row, state):
        total = (state[0] if state else 0) + row["price"]
        return row["event_type"] == "signup", (total,), [(user, row["event_id"], total)]

    def build(end):
        clicks = _with_end(_Streams(spark, d).clicks(), end)
        return folds.state_machine(
            clicks.select("bidder", "event_id", "event_type", "price", "date_time"), "bidder", "date_time", "event_id", fold,
            "user_id BIGINT, event_id BIGINT, total BIGINT", "total BIGINT",
        )

    return run_to_table(spark, build, "state-machine")


@stream
def state_machine(spark, d):
    return _machine(spark, d)[0]


@stream
def state_scan(spark, d):
    """What the machine above remembers after the last event: users whose last event is no sign-up."""
    state = scan_state(spark, _machine(spark, d)[1], "value1")
    return state.select(F.col("key.key").alias("user_id"), F.col("value.total").alias("total"))


@stream
def stateful_unary(spark, d):
    """Position of every event among those of its auction, in event-time order."""

    def fold(auction, due, state, later):
        n = (state.get() or (0,))[0]
        for _, row in due:
            n += 1
            yield (auction, row["event_id"], n)
        state.set((n,))

    def build(end):
        clicks = _with_end(_Streams(spark, d).clicks(), end).select("auction", "event_id", "date_time")
        return folds.stateful_unary(
            clicks, "auction", "date_time", "event_id", fold, "auction BIGINT, event_id BIGINT, position BIGINT"
        )

    return run_to_table(spark, build, "stateful-unary")[0]


@stream
def stateful_unary_input(spark, d):
    """Events moved to the end of their hour by the input hook: bids so far per auction and hour."""
    hour_us = HOUR * 1_000_000

    def fold(auction, due, state, later):
        n = (state.get() or (0,))[0] + len(due)
        state.set((n,))
        yield (auction, due[0][0], n)

    def build(end):
        clicks = _with_end(_Streams(spark, d).clicks(), end).select("auction", "event_id", "date_time")
        return folds.stateful_unary(
            clicks, "auction", "date_time", "event_id", fold, "auction BIGINT, slot_end_us BIGINT, bids BIGINT",
            due=(F.floor(F.unix_micros("date_time") / hour_us) + 1) * hour_us,
        )

    return run_to_table(spark, build, "stateful-unary-input")[0]


@stream
def stateful_binary(spark, d):
    """Latest-match join of clicks with sign-ups of the same user."""

    def build(end):
        clicks = _marked_end(_Streams(spark, d).clicks().select("bidder", "event_id", "event_type", "date_time"), end)
        left = clicks.where("event_type = 'signup' OR _end").drop("event_type", "_end")
        right = clicks.where("event_type = 'click' OR _end").drop("event_type", "_end")
        return sq.latest_match_join(left, right, "bidder", "date_time", "event_id")

    rows = run_to_table(spark, build, "stateful-binary")[0]
    return rows.select(
        F.col("key").alias("user_id"), F.col("left_id").alias("left_event_id"), F.col("right_id").alias("right_event_id")
    )


@stream
def stateful_binary_input(spark, d):
    """Purchases count for the hour after them: views of a user while a purchase is that fresh."""
    hour_us = HOUR * 1_000_000

    def on_purchase(user, due, fresh, unused, later):
        fresh.set(((fresh.get() or (0,))[0] + sum(row["change"] for _, row in due),))
        yield from ()

    def on_view(user, due, fresh, unused, later):
        n = (fresh.get() or (0,))[0]
        for _, row in due:
            yield (user, row["event_id"], n)

    def build(end):
        clicks = _marked_end(_Streams(spark, d).clicks().select("bidder", "event_id", "event_type", "date_time"), end)
        left = clicks.where("event_type = 'purchase' OR _end").drop("event_type", "_end")
        right = clicks.where("event_type = 'view' OR _end").drop("event_type", "_end")
        # A purchase counts from its time on and stops an hour later.
        left = left.withColumn("change", F.explode(F.array(F.lit(1), F.lit(-1))))
        stops = F.unix_micros("date_time") + F.when(F.col("change") < 0, hour_us).otherwise(0)
        return folds.stateful_binary(
            left, right, ("bidder", "bidder"), ("date_time", "date_time"), ("event_id", "event_id"),
            (on_purchase, on_view), "user_id BIGINT, event_id BIGINT, fresh BIGINT",
            dues=(stops, None),
        )

    return run_to_table(spark, build, "stateful-binary-input")[0]


@stream
def stream_distribute(spark, d):
    """Events routed by the control log of the same events, both as streams."""
    s = _Streams(spark, d)

    def build(end):
        lines = control_lines(tables.clicks_of(s._table("events")))
        parsed = parse_control_lines(lines).select(F.timestamp_micros("ts").alias("at"), "bin", "worker", F.col("msg").alias("order"))
        records = s.clicks().select("event_id", F.col("bidder").alias("user_id"), "date_time")
        bins = scalars.bin_of_dense("user_id", BIN_SHIFT)
        return routing.distribute(_with_end(records, end), bins, "date_time", "event_id", _with_end(parsed, end), lambda b: b % WORKERS, slot_seconds=HOUR)

    return run_to_table(spark, build, "stream-distribute")[0]


def _timed(spark, d, name, cancelled):
    """Every event delivered `price` seconds after its time; a sign-up drops its user's events that are not yet due."""

    def build(end):
        clicks = _marked_end(_Streams(spark, d).clicks().select("bidder", "event_id", "event_type", "price", "date_time"), end)
        due = F.unix_micros("date_time") + F.col("price") * 1_000_000
        cancels = clicks.where("event_type = 'signup' OR _end") if cancelled else None
        return timers.event_timers(clicks, "bidder", "date_time", "event_id", F.when(~F.col("_end"), due), cancels=cancels)

    rows = run_to_table(spark, build, name)[0]
    return rows.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "due_us", "position")


@stream
def stream_event_timers(spark, d):
    return _timed(spark, d, "stream-timers", False)


@stream
def stream_event_timers_cancelled(spark, d):
    return _timed(spark, d, "stream-timers-cancelled", True)
