"""Streaming forms: against the batch results, over many micro-batches, and the fold rules."""

import os

import pytest
from oracle_check import compare
from pyspark.sql import Window, functions as F

from bidflow.operators import changelog
from bidflow.plans import auctions as q
from bidflow.plans.oracle import ORACLE
from bidflow.sources import tables
from bidflow.streaming import folds, queries as sq
from bidflow.streaming.registry import STREAMS, _with_end
from bidflow.streaming.runs import read_stream, run_to_table, scan_state


@pytest.mark.parametrize("name", list(STREAMS))
def test_stream(name, spark, sf_dir, duck):
    assert compare(STREAMS[name](spark, sf_dir), duck, ORACLE[name]) is None


def _files(df, path, order, n):
    """Writes `n` files in the order a stream with one file per trigger reads them."""
    ordered = df.orderBy(order).withColumn("_part", F.ntile(n).over(Window.orderBy(order)))
    ordered = ordered.cache()
    for i in range(1, n + 1):
        ordered.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            full = os.path.join(path, name)
            if name.endswith(".parquet") and os.path.getmtime(full) > 1_000_000_000 + n:
                os.utime(full, (1_000_000_000 + i, 1_000_000_000 + i))
    return path


def test_many_micro_batches_give_the_same_sums(spark, sf_dir, tmp_path):
    """One file per trigger, in time order: the fold sees the same order as in a single batch."""
    events = sq.with_timestamps(tables.clicks(spark, sf_dir)).select("auction", "event_id", "price", "date_time")
    path = _files(events, str(tmp_path / "events"), "date_time", 5)

    def fold(key, row, state):
        total = (state[0] if state else 0) + row["price"]
        return False, (total,), [(key, row["event_id"], total)]

    def build(end):
        stream = _with_end(read_stream(spark, path, files_per_trigger=1), end)
        return folds.state_machine(
            stream, "auction", "date_time", "event_id", fold, "key BIGINT, event_id BIGINT, total BIGINT", "total BIGINT"
        )

    from bidflow.plans.words import word_count_running

    found, _ = run_to_table(spark, build, "sums")
    words = tables.clicks(spark, sf_dir).selectExpr("date_time AS ts", "event_id", "auction AS key", "price AS val")
    expected = word_count_running(words, ["ts", "event_id"]).select("key", "event_id", "total")
    assert changelog.verify_equal(expected, found).count() == 0


def test_rows_wait_for_their_due_time(spark, sf_dir):
    """Three busy keys whose rows are due up to six days later: folded in due order, and nothing is left."""

    def fold(key, due, state, later):
        n = (state.get() or (0,))[0]
        for us, row in due:
            n += 1
            yield (key, row["event_id"], n, us)
        state.set((n,))

    def build(end):
        clicks = read_stream(spark, f"{sf_dir}/events.parquet")
        events = _with_end(sq.with_timestamps(tables.clicks_of(clicks)), end).selectExpr(
            "CAST(bidder % 3 AS BIGINT) AS k", "event_id", "date_time"
        )
        days = F.when(F.col("event_id") >= 0, F.col("event_id") % 7).otherwise(0)
        return folds.stateful_unary(
            events, "k", "date_time", "event_id", fold, "k BIGINT, event_id BIGINT, n BIGINT, us BIGINT",
            due=F.unix_micros("date_time") + days * 86_400_000_000,
        )

    from bidflow.plans.words import time_ordered

    found, checkpoint = run_to_table(spark, build, "parts")
    due = tables.clicks(spark, sf_dir).selectExpr(
        "CAST(bidder % 3 AS BIGINT) AS k", "event_id",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', date_time) + (event_id % 7) * 86400000000L AS us",
    )
    expected = time_ordered(due, ["k"], ["us", "event_id"]).withColumnRenamed("position", "n").select("k", "event_id", "n", "us")
    assert changelog.verify_equal(expected, found).count() == 0
    # Of the queue only the end marker is left.
    assert operator_rows(spark, checkpoint, "stateStoreSave") <= 1


def operator_rows(spark, checkpoint, name):
    """State rows of all operators of a name (of both sides, for a join)."""
    found = 0
    for op in spark.read.format("state-metadata").load(checkpoint).filter(F.col("operatorName") == name).select("operatorId", "stateStoreName").distinct().collect():
        reader = spark.read.format("statestore").option("operatorId", op.operatorId)
        if name == "symmetricHashJoin":
            if op.stateStoreName != "left-keyToNumValues":
                continue
            found += sum(reader.option("joinSide", side).load(checkpoint).count() for side in ("left", "right"))
        else:
            found += reader.load(checkpoint).count()
    return found


def test_late_rows_are_dropped(spark, tmp_path):
    rows = spark.sql(
        "SELECT id AS auction, id AS bidder, id AS price, timestamp_seconds(id * 10) AS date_time FROM range(100, 110)"
    )
    path = _files(rows, str(tmp_path / "bids"), "date_time", 2)
    late = spark.sql("SELECT 1L AS auction, 1L AS bidder, 999L AS price, timestamp_seconds(1) AS date_time")
    late.coalesce(1).write.mode("append").parquet(path)
    newest = max((os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")), key=os.path.getmtime)
    os.utime(newest, (1_000_000_100, 1_000_000_100))

    def build(end):
        return sq.q7(_with_end(read_stream(spark, path, files_per_trigger=1), end), 10)

    found, _ = run_to_table(spark, build, "late")
    assert 999 not in {r["price"] for r in found.collect()}
    assert found.count() == 10


def test_timers_of_two_inputs(spark, tmp_path):
    """Two inputs with nine rows each: every row once, in time order, first input first.

    Times start after 1970: a stream's first watermark is 1970-01-01, and Spark drops rows up to it.
    """
    for name in ("in1", "in2"):
        spark.sql("SELECT id AS d, timestamp_seconds(1000 + id) AS at FROM range(9)").write.parquet(str(tmp_path / name))

    def deliver(number):
        def fold(key, due, state1, state2, later):
            n = (state1.get() or (0,))[0]
            for us, row in due:
                n += 1
                yield (n, number, us, row["d"])
            state1.set((n,))

        return fold

    def build(end):
        def side(name):
            return read_stream(spark, str(tmp_path / name)).select(F.lit(1).cast("bigint").alias("k"), "d", "at")

        marker = end.select(F.lit(-1).cast("bigint").alias("k"), F.lit(-1).cast("bigint").alias("d"), F.col("time").alias("at"))
        left, right = side("in1").unionByName(marker), side("in2").unionByName(marker)
        return folds.stateful_binary(
            left, right, ("k", "k"), ("at", "at"), ("d", "d"), (deliver(1), deliver(2)), "n BIGINT, input INT, us BIGINT, d BIGINT"
        )

    found, _ = run_to_table(spark, build, "timers")
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [(2 * d + i, i, (1000 + d) * 1_000_000, d) for d in range(9) for i in (1, 2)]


def test_folds_can_schedule_rows(spark, tmp_path):
    """Each row comes back twice, one second later each time, between the rows that are due then."""
    spark.sql("SELECT id AS d, timestamp_seconds(1000 + id) AS at FROM range(3)").write.parquet(str(tmp_path / "in"))

    def fold(key, due, state, later):
        n = (state.get() or (0,))[0]
        for us, row in due:
            n += 1
            hop = row["hop"]
            yield (n, us // 1_000_000, row["d"], hop)
            if hop < 2:
                later.at(us + 1_000_000, {"d": row["d"], "hop": hop + 1}, order=row["d"])
        state.set((n,))

    def build(end):
        stream = read_stream(spark, str(tmp_path / "in")).select(F.lit(1).cast("bigint").alias("k"), "d", "at")
        stream = stream.withColumn("hop", F.lit(0))
        marker = end.select(F.lit(-1).cast("bigint").alias("k"), F.lit(-1).cast("bigint").alias("d"), F.col("time").alias("at"), F.lit(0).alias("hop"))
        return folds.stateful_unary(stream.unionByName(marker), "k", "at", "d", fold, "n BIGINT, s BIGINT, d BIGINT, hop INT", schedules=True)

    found, _ = run_to_table(spark, build, "hops")
    rows = sorted(tuple(r) for r in found.collect())
    assert [(s, d, hop) for _, s, d, hop in rows] == sorted((1000 + d + hop, d, hop) for d in range(3) for hop in range(3))
    assert [r[0] for r in rows] == list(range(1, 10))


def test_scheduled_rows_wait_between_triggers_and_can_be_cancelled(spark, tmp_path):
    """Rows scheduled for hours later, over one trigger per row: typed state and timers hold them; every fourth row cancels."""
    rows = spark.sql("SELECT id AS d, timestamp_seconds(1000 + id * 1800) AS at FROM range(12)")
    path = _files(rows, str(tmp_path / "in"), "at", 12)

    def fold(key, due, state, later):
        for us, row in due:
            if row["again"]:
                yield (row["d"], us // 1_000_000)
            elif row["d"] % 4 == 3:
                later.cancel(lambda at, r: r["d"] % 2 == 0)
            else:
                later.at(us + 5 * 3_600_000_000 + row["d"], {**row, "again": True})

    def build(end):
        stream = read_stream(spark, path, files_per_trigger=1).select(F.lit(1).cast("bigint").alias("k"), "d", "at", F.lit(False).alias("again"))
        marker = end.select(F.lit(-1).cast("bigint").alias("k"), F.lit(-1).cast("bigint").alias("d"), F.col("time").alias("at"), F.lit(False).alias("again"))
        return folds.stateful_unary(stream.unionByName(marker), "k", "at", "d", fold, "d BIGINT, s BIGINT", schedules=True)

    found, checkpoint = run_to_table(spark, build, "cancelled")
    waiting, expected = {}, []
    for d in range(12):
        at = 1000 + d * 1800
        expected += [(w, s) for w, s in waiting.items() if s <= at]
        waiting = {w: s for w, s in waiting.items() if s > at}
        if d % 4 == 3:
            waiting = {w: s for w, s in waiting.items() if w % 2}
        else:
            waiting[d] = at + 18_000
    expected += list(waiting.items())
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
    assert scan_state(spark, checkpoint, "waiting1").count() == 0


def test_timers_over_many_triggers(spark, sf_dir, tmp_path):
    """Timers with payload, with and without cancelling, one file per trigger, against the rule on all rows."""
    from bidflow.streaming.timers import event_timers

    events = sq.with_timestamps(tables.clicks(spark, sf_dir)).selectExpr("bidder % 20 AS bidder", "event_id", "event_type", "price", "date_time")
    path = _files(events, str(tmp_path / "events"), "date_time", 6)
    rows = [(r.bidder, r.event_id, r.event_type, r.us, r.price) for r in events.withColumn("us", F.unix_micros("date_time")).collect()]
    for cancelling in (False, True):

        def build(end):
            stream = _with_end(read_stream(spark, path, files_per_trigger=1), end)
            due = F.when(F.col("event_id") >= 0, F.unix_micros("date_time") + F.col("price") * 1_000_000)
            cancels = stream.where("event_type = 'signup' OR event_id < 0") if cancelling else None
            return event_timers(stream, "bidder", "date_time", "event_id", due, {"event_type": "string", "price": "bigint"}, cancels)

        found = sorted(tuple(r) for r in run_to_table(spark, build, "timers")[0].collect())
        kept = [
            (k, e, us + p * 1_000_000, kind, p) for k, e, kind, us, p in rows
            if not (cancelling and any(o[0] == k and o[2] == "signup" and us < o[3] < us + p * 1_000_000 for o in rows))
        ]
        expected, count = [], {}
        for k, e, due, kind, p in sorted(kept, key=lambda r: (r[0], r[2], r[1])):
            count[k] = count.get(k, 0) + 1
            expected.append((k, e, due, count[k], kind, p))
        assert found == sorted(expected)


def test_late_control_holds_records_back(spark, tmp_path):
    """Control arrives triggers later than the records it is for; each record still gets the version of its time."""
    from bidflow.streaming.routing import distribute

    records = spark.sql("SELECT id, id % 5 AS k, timestamp_seconds(1000 + id * 60) AS at FROM range(200)")
    control = spark.sql("SELECT timestamp_seconds(1000 + id * 600) AS at, id % 5 AS bin, 10 + id AS worker, id AS order FROM range(20)")
    left, right = _files(records, str(tmp_path / "records"), "at", 2), _files(control, str(tmp_path / "control"), "at", 7)

    def build(end):
        def marked(df):
            fields = [F.col("time") if f.name == "at" else F.lit(-1).cast(f.dataType) for f in df.schema.fields]
            return df.unionByName(end.select(*[c.alias(n) for c, n in zip(fields, df.columns)]))

        stream = read_stream(spark, left, files_per_trigger=1)
        return distribute(marked(stream), F.col("k"), "at", "id", marked(read_stream(spark, right, files_per_trigger=1)), lambda b: None if b == 4 else b, salts=3)

    found = sorted((r.id, r.bin, r.worker, r.valid_from_us) for r in run_to_table(spark, build, "late-control")[0].collect())
    expected = []
    for i in range(200):
        versions = [j for j in range(20) if j % 5 == i % 5 and j * 600 <= i * 60]
        if versions:
            expected.append((i, i % 5, 10 + versions[-1], (1000 + versions[-1] * 600) * 1_000_000))
        elif i % 5 != 4:
            expected.append((i, i % 5, i % 5, None))
    assert found == expected


def test_waiting_control_is_held_once(spark, tmp_path):
    """While control waits, state has one row per bin and slot, not one per key that a bin's records are dealt over."""
    from bidflow.streaming.routing import distribute

    records = spark.sql("SELECT id, id % 2 AS k, timestamp_seconds(id) AS at FROM range(100)")
    control = spark.sql("SELECT timestamp_seconds(id) AS at, id % 2 AS bin, id AS worker, id AS order FROM range(100)")
    left, right = _files(records, str(tmp_path / "records"), "at", 1), _files(control, str(tmp_path / "control"), "at", 1)

    def build(end):
        return distribute(read_stream(spark, left), F.col("k"), "at", "id", read_stream(spark, right), lambda b: b, slot_seconds=1000)

    checkpoint = run_to_table(spark, build, "held-once", flush=False)[1]
    assert operator_rows(spark, checkpoint, "stateStoreSave") == 2


def test_streamed_closed_auctions_keep_nothing(spark, sf_dir):
    """After the end no auction is open any more."""
    from bidflow.streaming.registry import _closed

    rows, checkpoint = _closed(spark, sf_dir)
    assert rows.count() == q.closed_auctions(tables.auctions(spark, sf_dir), tables.bids(spark, sf_dir)).count()
    # What is left is the end marker.
    assert operator_rows(spark, checkpoint, "symmetricHashJoin") <= 2
    assert operator_rows(spark, checkpoint, "stateStoreSave") == 0


def test_closed_auctions_wait_in_one_row_per_auction(spark, tmp_path):
    """An auction and its bids are one row of state; ids may repeat or be null, and bids may meet no auction."""
    time = "timestamp_seconds(100 * 86400 + {})"
    auctions, bids = str(tmp_path / "auctions"), str(tmp_path / "bids")
    columns = f"id, s seller, s category, r initial_bid, r reserve, {time.format('o')} date_time, {time.format('e')} expires"
    rows = "(1, 1, 10, 0, 100), (1, 2, 50, 20, 200), (1, 2, 50, 20, 200), (2, 3, 10, 0, 100), (3, 4, 10, 50, 50), (NULL, 5, 10, 0, 100)"
    spark.sql(f"SELECT {columns} FROM VALUES {rows} AS t(id, s, r, o, e)").selectExpr(
        *[f"CAST({c} AS BIGINT) {c}" for c in ("id", "seller", "category", "initial_bid", "reserve")], "date_time", "expires"
    ).write.parquet(auctions)
    offers = "(1, 7, 40, 10), (1, 8, 60, 30), (1, 9, 60, 20), (1, 6, 60, 20), (1, 5, 90, 200), (2, 7, 9, 50), (2, 7, 90, 100), (3, 7, 90, 50), (9, 7, 90, 50), (NULL, 7, 90, 50)"
    spark.sql(f"SELECT CAST(a AS BIGINT) auction, CAST(b AS BIGINT) bidder, CAST(p AS BIGINT) price, {time.format('t')} date_time FROM VALUES {offers} AS t(a, b, p, t)").write.parquet(bids)

    def build(end):
        return sq.closed_auctions(*[_with_end(read_stream(spark, path), end) for path in (auctions, bids)])

    checkpoint = run_to_table(spark, build, "open", flush=False)[1]
    assert 0 < operator_rows(spark, checkpoint, "sessionWindowStateStoreSaveExec") <= 4
    found, checkpoint = run_to_table(spark, build, "closed")
    assert sorted((r.id, r.seller, r.bidder, r.price) for r in found.collect()) == [(1, 1, 6, 60), (1, 2, 6, 60)]
    assert operator_rows(spark, checkpoint, "sessionWindowStateStoreSaveExec") == 0
    assert operator_rows(spark, checkpoint, "symmetricHashJoin") == 0


def test_open_auctions_take_little_disk(spark, tmp_path):
    """20,000 auctions and 80,000 bids on many days wait in less than 50 bytes a row, and only in the checkpoint."""
    day = "timestamp_seconds(8000 * 86400 + pmod(xxhash64(id, {}), 2400) * 86400)"
    spark.sql(
        f"SELECT id, pmod(xxhash64(id, 1), 15000) seller, 10L category, pmod(xxhash64(id, 2), 50000000) initial_bid, 5L reserve,"
        f" {day.format(3)} date_time, {day.format(3)} + INTERVAL '365' DAY expires FROM range(20000)"
    ).write.parquet(str(tmp_path / "auctions"))
    spark.sql(
        f"SELECT pmod(xxhash64(id, 4), 20000) auction, pmod(xxhash64(id, 5), 1000) bidder, pmod(xxhash64(id, 6), 10000000) price, {day.format(7)} date_time FROM range(80000)"
    ).write.parquet(str(tmp_path / "bids"))
    local = spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())

    def stored(path):
        return {os.path.join(at, f): os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files if f.endswith((".sst", ".log"))}

    before = set(stored(local))

    def build(end):
        return sq.closed_auctions(*[_with_end(read_stream(spark, str(tmp_path / name)), end) for name in ("auctions", "bids")], slot_seconds=365 * 86_400)

    checkpoint = run_to_table(spark, build, "open", flush=False)[1]
    assert 0 < sum(stored(f"{checkpoint}/state").values()) < 50 * 100_000
    assert not set(stored(local)) - before


def test_closed_auctions_in_parts(spark, sf_dir):
    """Runs over a third of the keys each give the rows of one run; the state of a part goes before the next one."""
    from bidflow.streaming.registry import _closed
    from bidflow.streaming.runs import RUN_BYTES_CONF

    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    files = sum(os.path.getsize(f"{sf_dir}/{name}.parquet") for name in ("orders", "lineitem"))
    spark.conf.set(RUN_BYTES_CONF, str(files // 3 + 1))
    try:
        rows, checkpoint = _closed(spark, sf_dir)
    finally:
        spark.conf.unset(RUN_BYTES_CONF)
    runs = [f"{shared}/{f}" for f in os.listdir(shared) if f not in before]
    assert len(runs) == 3 and [f"{r}/checkpoint" for r in runs if os.path.exists(f"{r}/checkpoint")] == [checkpoint]
    expected = q.closed_auctions(tables.auctions(spark, sf_dir), tables.bids(spark, sf_dir))
    columns = ["id", "seller", "category", "reserve", "bidder", "price"]
    assert changelog.verify_equal(expected.select(*columns), rows.select(*columns)).count() == 0


def test_running_q4_in_parts(spark, sf_dir, duck):
    """Auctions closed in runs over parts of their keys are folded in order of expiry over all parts; no store stays open on local disk."""
    from bidflow.streaming.runs import RUN_BYTES_CONF

    local = spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())

    def stored():
        return {os.path.join(at, f) for at, _, files in os.walk(local) for f in files if f.endswith((".sst", ".log"))}

    shared, before = spark.conf.get("spark.checkpoint.dir"), stored()
    runs = {f for f in os.listdir(shared) if f.startswith("closed-log-")}
    spark.conf.set(RUN_BYTES_CONF, str(os.path.getsize(f"{sf_dir}/lineitem.parquet")))
    try:
        found = STREAMS["stream_q4_running"](spark, sf_dir)
    finally:
        spark.conf.unset(RUN_BYTES_CONF)
    assert compare(found, duck, ORACLE["stream_q4_running"]) is None
    runs = {f for f in os.listdir(shared) if f.startswith("closed-log-")} - runs
    assert len(runs) == 2 and sum(os.path.exists(f"{shared}/{f}/checkpoint") for f in runs) == 1
    assert not stored() - before


def test_closed_auctions_over_many_triggers(spark, sf_dir, tmp_path):
    """One file per trigger and short slots: the same winners as in one batch over tables."""
    auctions = sq.with_timestamps(tables.auctions(spark, sf_dir)).withColumn("expires", F.col("date_time") + F.expr("make_interval(0, 0, 0, id % 40)"))
    bids = sq.with_timestamps(tables.bids(spark, sf_dir))
    paths = [_files(df, str(tmp_path / name), "date_time", 4) for df, name in ((auctions, "auctions"), (bids, "bids"))]

    def build(end):
        streams = [_with_end(read_stream(spark, path, files_per_trigger=1), end) for path in paths]
        return sq.closed_auctions(*streams, slot_seconds=10 * 86_400)

    found, _ = run_to_table(spark, build, "closed")
    expected = q.closed_auctions(auctions, bids)
    columns = ["id", "seller", "reserve", "bidder", "price"]
    assert expected.count() > 0
    assert changelog.verify_equal(expected.select(*columns), found.select(*columns)).count() == 0


def test_streamed_event_log(spark, sf_dir, tmp_path):
    """A stream of tagged events captured into a log and replayed as three streams."""
    from bidflow.sources import logs

    views = [tables.people(spark, sf_dir), tables.auctions(spark, sf_dir), tables.bids(spark, sf_dir)]
    tagged = tables.tagged_events(*views)
    source, log = str(tmp_path / "source"), str(tmp_path / "log")
    logs.capture(tagged, source)
    logs.capture_stream(read_stream(spark, source), log, str(tmp_path / "checkpoint")).awaitTermination()
    branches = tables.demux(logs.replay_stream(spark, log, tagged.schema))
    for i, (expected, branch) in enumerate(zip(views, branches)):
        found, _ = run_to_table(spark, lambda end: branch, f"branch{i}", flush=False)
        assert changelog.verify_equal(expected, found.select(*expected.columns)).count() == 0


def test_records_due_after_2200_are_folded(spark, tmp_path):
    """Due times in 2270, and one beyond what Python's datetime holds."""
    path = str(tmp_path / "in")
    spark.sql("SELECT id AS d, timestamp_seconds(1000 + id) AS at FROM range(4)").write.parquet(path)
    far = {0: 1_000_000, 1: 9_500_000_000_000_000, 2: 9_500_000_000_000_001, 3: 300_000_000_000_000_000}

    def fold(key, due, state, later):
        yield from ((row["d"], us) for us, row in due)

    def build(end):
        stream = read_stream(spark, path).select(F.lit(1).cast("bigint").alias("k"), "d", "at")
        marker = end.select(F.lit(-1).cast("bigint").alias("k"), F.lit(-1).cast("bigint").alias("d"), F.col("time").alias("at"))
        return folds.stateful_unary(
            stream.unionByName(marker), "k", "at", "d", fold, "d BIGINT, us BIGINT",
            due=F.create_map(*[F.lit(x).cast("bigint") for pair in far.items() for x in pair])[F.col("d")],
        )

    found, _ = run_to_table(spark, build, "far")
    assert sorted((r.d, r.us) for r in found.collect() if r.d > 0) == [(d, far[d]) for d in (1, 2, 3)]


def test_events_without_a_type_are_not_the_end(spark, sf_dir, tmp_path):
    """The two-input streams over events some of which have no type, against the batch join."""
    from bidflow.plans.registry import QUERIES

    folder = tmp_path / "some"
    folder.mkdir()
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("event_type", F.when(F.col("event_id") % 7 > 0, F.col("event_type"))).write.parquet(str(folder / "events.parquet"))
    for name in ("stateful_binary",):
        found = STREAMS[name](spark, str(folder))
        expected = QUERIES["latest_match_join"](spark, str(folder)).select("user_id", "left_event_id", "right_event_id")
        assert changelog.verify_equal(expected, found.select(*expected.columns)).count() == 0
