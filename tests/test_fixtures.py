"""Hand-made cases with known results."""

import datetime as dt

import pytest

from bidflow.functions import scalars
from bidflow.operators import changelog, joins, latency, routing
from bidflow.plans import auctions as q
from bidflow.plans import words as w
from bidflow.sources import logs
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def auctions(spark, *items):
    """(id, seller, category, reserve, opened, expires), times in seconds."""
    data = [(i, r, r, at(o), at(e), s, c) for i, s, c, r, o, e in items]
    return spark.createDataFrame(
        data,
        "id BIGINT, initial_bid BIGINT, reserve BIGINT, date_time TIMESTAMP_NTZ, expires TIMESTAMP_NTZ, seller BIGINT, category BIGINT",
    )


def bids(spark, *items):
    """(auction, bidder, price, time)."""
    return spark.createDataFrame(
        [(a, b, p, at(t)) for a, b, p, t in items], "auction BIGINT, bidder BIGINT, price BIGINT, date_time TIMESTAMP_NTZ"
    )


def people(spark, *items):
    """(id, state, time)."""
    return spark.createDataFrame(
        [(i, f"n{i}", f"c{i}", s, at(t)) for i, s, t in items],
        "id BIGINT, name STRING, city STRING, state STRING, date_time TIMESTAMP_NTZ",
    )


# -- routing -------------------------------------------------------------------------------------

CONTROL = "ts BIGINT, sequence BIGINT, count BIGINT, msg BIGINT, kind STRING, pos BIGINT, bin BIGINT, worker BIGINT"
SUMS = [(0, 0), (0, 2), (0, 6), (0, 12), (0, 20), (1, 1), (1, 4), (1, 9), (1, 16), (1, 25)]


def whole_map(ts, sequence, worker, bins=2):
    return [(ts, sequence, 1, 0, "M", b, b, worker) for b in range(bins)]


CASES = {
    "default": ([], lambda x: x % 2),
    "custom": (whole_map(0, 0, 0) + whole_map(5, 1, 1), lambda x: int(x >= 5)),
    "adjacent": (whole_map(0, 0, 0) + whole_map(1, 1, 1), lambda x: int(x >= 1)),
}


@pytest.mark.parametrize("case", list(CASES))
def test_running_sums_do_not_depend_on_the_map(spark, small, case):
    control, worker = CASES[case]
    numbers = spark.range(10).selectExpr("id AS ts", "id % 2 AS key", "id AS val")
    history = routing.control_history(spark.createDataFrame(control, CONTROL), routing.initial_map(spark, 2, 2))
    routed = routing.distribute(numbers, F.col("key"), "ts", history)
    assert rows(routed, "ts", "worker") == [(x, worker(x)) for x in range(10)]
    totals = w.word_count_running(routed.select("ts", "key", "val"), ["ts"])
    assert rows(totals, "key", "total") == SUMS


def test_ordered_routing_equals_broadcast_routing(spark, form):
    control = whole_map(3, 0, 0, 4) + [(5, 1, 2, 0, "D", 0, 1, 7), (5, 1, 2, 1, "D", 1, 1, 8)] + whole_map(8, 2, 1, 4)
    history = routing.control_history(spark.createDataFrame(control, CONTROL), routing.initial_map(spark, 4, 2))
    records = spark.range(40).selectExpr("id AS n", "id div 4 AS ts", "id % 4 AS key")
    quick = routing.distribute(records, F.col("key"), "ts", history)
    ordered = routing._distribute_ordered(records, F.col("key"), "ts", history)
    columns = ["n", "bin", "worker", "valid_from"]
    assert quick.count() == 40
    key = lambda r: r[0]
    assert sorted(map(tuple, quick.select(columns).collect()), key=key) == sorted(
        map(tuple, ordered.select(columns).collect()), key=key
    )


def test_inconsistent_sequence_is_reported(spark):
    control = [(3, 10, 1, 0, "N", 0, None, None), (3, 9, 1, 0, "N", 0, None, None), (4, 11, 1, 0, "N", 0, None, None)]
    assert rows(routing.control_violations(spark.createDataFrame(control, CONTROL)), "ts") == [(3,)]


def test_missing_message_is_reported(spark):
    control = [(3, 1, 2, 0, "D", 0, 0, 1), (4, 2, 2, 0, "D", 0, 0, 1), (4, 2, 2, 1, "D", 1, 1, 1)]
    assert rows(routing.control_violations(spark.createDataFrame(control, CONTROL)), "ts", "messages", "expected") == [(3, 1, 2)]


def test_control_log(spark, small, tmp_path):
    path = tmp_path / "control.log"
    path.write_text("M 0 0 1 0 1\nD 100 1 0\nD 200 0 1 2 1\n")
    control = logs.read_control_log(spark, str(path))
    assert rows(control, "ts", "kind", "bin", "worker") == [
        (0, "M", 0, 0), (0, "M", 1, 1), (0, "M", 2, 0), (0, "M", 3, 1), (100, "D", 1, 0), (200, "D", 0, 1), (200, "D", 2, 1),
    ]
    assert routing.control_violations(control).count() == 0
    history = routing.control_history(control, routing.initial_map(spark, 4, 2))
    for ts, expected in [(0, [0, 1, 0, 1]), (100, [0, 0, 0, 1]), (200, [1, 0, 1, 1])]:
        probe = spark.range(4).selectExpr("id", f"CAST({ts} AS BIGINT) AS ts")
        assert [r[1] for r in rows(routing.distribute(probe, F.col("id"), "ts", history), "id", "worker")] == expected
    records = spark.range(8).selectExpr("id AS n", "id % 4 AS key", "id * 30 AS ts")
    routed = routing.distribute(records, F.col("key"), "ts", history)
    assert rows(routing.moved_bins(history, routed)) == [(100, 1, 1, 0, 1), (200, 0, 0, 1, 2), (200, 2, 0, 1, 2)]


def test_unknown_control_letter_fails(spark):
    lines = spark.createDataFrame([("X 1 2 3",)], "value STRING")
    with pytest.raises(Exception, match="unknown control line"):
        logs.parse_control_lines(lines).collect()


def test_bins():
    assert scalars.bin_of_hash("k", 0) is not None


def test_hash_bins_are_in_range(spark):
    bins = {r[0] for r in spark.range(1000).select(scalars.bin_of_hash("id", 4)).collect()}
    assert bins == set(range(16))


# -- auctions ------------------------------------------------------------------------------------

BIDS = [(1, 1, 99, 12), (1, 2, 100, 10), (1, 3, 150, 9), (1, 4, 150, 20), (1, 5, 120, 15), (1, 6, 120, 13)]


def test_closed_auctions(spark, form):
    a = auctions(spark, (1, 7, 10, 100, 10, 20), (2, 7, 10, 100, 10, 20))
    closed = q.closed_auctions(a, bids(spark, *BIDS, (2, 9, 50, 11)))
    assert rows(closed, "id", "bidder", "price", "bid_time") == [(1, 6, 120, at(13))]
    early = q.closed_auctions(a, bids(spark, *BIDS), lower_bound=False)
    assert rows(early, "id", "bidder", "price", "bid_time") == [(1, 3, 150, at(9))]


def test_q3_and_q3_latest(spark, form):
    a = auctions(spark, (1, 7, 10, 1, 1, 9), (2, 7, 10, 1, 2, 9), (3, 7, 10, 1, 5, 9), (4, 7, 11, 1, 2, 9), (5, 8, 10, 1, 2, 9))
    p = people(spark, (7, "OR", 3), (8, "WA", 3))
    assert rows(q.q3(a, p), "name", "auction") == [("n7", 1), ("n7", 2), ("n7", 3)]
    assert rows(q.q3_latest(a, p), "name", "auction") == [("n7", 2), ("n7", 3)]
    assert rows(q.q3_semijoin(a, p), "id") == [(7,)]


def test_q5(spark):
    b = bids(spark, (1, 1, 1, 0.1), (1, 1, 1, 0.2), (2, 1, 1, 0.3), (2, 1, 1, 1.5))
    assert rows(q.q5(b, 3, 1), "window_end", "auction") == [(at(1), 1), (at(2), 2), (at(3), 2), (at(4), 2)]


def test_q6(spark, form):
    a = auctions(spark, *[(i, 1, 10, 0, 0, i) for i in range(1, 13)])
    closed = q.closed_auctions(a, bids(spark, *[(i, 5, i, 0.5) for i in range(1, 13)]))
    found = [r[1] for r in rows(q.q6(closed), "id", "avg_price")]
    assert found == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7]


def test_q7(spark):
    b = bids(spark, (1, 1, 5, 0), (1, 2, 9, 9.999), (1, 3, 3, 10))
    assert rows(q.q7(b, 10)) == [(at(10), 9), (at(20), 3)]
    assert rows(q.q7_argmax(b, 10), "auction", "price", "bidder") == [(1, 3, 3), (1, 9, 2)]


def test_q8(spark, form):
    a = auctions(spark, (1, 1, 10, 5, 0, 99), (2, 1, 10, 6, 9, 99), (3, 1, 10, 7, 10, 99), (4, 2, 10, 8, 5, 99))
    p = people(spark, (1, "OR", 0))
    assert rows(q.q8(a, p, 10)) == [(1,), (1,)]
    assert rows(q.q8_changelog(a, p, 10), "reserve", "time", "diff") == [
        (5, at(0), 1), (5, at(10), -1), (6, at(9), 1), (6, at(10), -1),
    ]


def test_latest_match_join(spark, form):
    left = spark.createDataFrame([("k", 2, 1, "v1"), ("k", 5, 2, "v2")], "key STRING, ts BIGINT, n BIGINT, v STRING")
    right = spark.createDataFrame(
        [("k", 1, 1, "a"), ("k", 3, 2, "b"), ("k", 6, 3, "c"), ("k", 5, 4, "e"), ("j", 1, 5, "d")], "key STRING, ts BIGINT, n BIGINT, w STRING"
    )
    found = joins.latest_match_join(left, right, "key", "ts", "n", "n")
    assert rows(found, "key", "left_v", "right_w") == [("k", "v1", "a"), ("k", "v1", "b"), ("k", "v2", "c"), ("k", "v2", "e")]


# -- multisets -----------------------------------------------------------------------------------


def test_consolidate_and_verify(spark):
    changes = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("b", 1, 1), ("b", 1, -1), ("a", 2, -1)], "k STRING, time BIGINT, diff BIGINT")
    assert rows(changelog.consolidate(changes)) == [("a", 1, 2), ("a", 2, -1)]
    assert changelog.consolidate(changelog.concat(changes, changelog.negate(changes))).count() == 0
    left = spark.createDataFrame([("a",), ("a",), ("b",)], "k STRING")
    right = spark.createDataFrame([("a",), ("b",), ("c",)], "k STRING")
    assert rows(changelog.verify_equal(left, right)) == [("a", 2, 1), ("c", 0, 1)]
    assert changelog.verify_equal(left, left.repartition(3)).count() == 0


# -- latency -------------------------------------------------------------------------------------


def test_histogram_bucket(spark):
    values = [0, 1, 15, 16, 17, 31, 32, 33, 34, 1000, 1 << 40, 122880, 123000]
    df = spark.createDataFrame([(v,) for v in values], "v BIGINT")
    found = [r[0] for r in df.select(scalars.histogram_bucket("v")).collect()]
    assert found == [0, 1, 15, 16, 17, 31, 32, 32, 34, 992, 1 << 40, 122880, 122880]


def timeline(spark, p50s):
    data = [("r", t, p - 1, p, p + 1, p + 2, p + 3, p + 4, p + 5) for t, p in enumerate(p50s)]
    return spark.createDataFrame(data, "run STRING, time BIGINT, " + ", ".join(f"{c} BIGINT" for c in logs.QUANTILE_COLUMNS))


def sequential_incidents(p50s, triggers, base):
    """The rule of the breakdown told as a loop over the buckets."""
    queue, counting, duration, worst, interval = sorted(triggers), False, 0, None, None
    for t, p in enumerate(p50s):
        if t == 1:
            interval = 1
        if interval and queue and queue[0] + interval <= t:
            queue.pop(0)
            counting = True
        if counting and p > 2 * base:
            duration += 1
            worst = max(worst or 0, p)
        else:
            counting = False
    return [("r", duration, worst)] if duration else []


@pytest.mark.parametrize(
    "p50s, triggers",
    [
        ([1, 1, 9, 9, 1, 9, 1, 9], [1]),
        ([9, 9, 9, 9, 9, 1, 9, 9, 7], [0, 0, 5]),
        ([1, 9, 1, 9, 8, 9, 1, 1, 9, 9], [0, 1, 2, 7]),
        ([9, 1, 1], [8]),
        ([1, 9, 1, 9, 9, 1, 9], [0, 0, 6, 6, 7]),
        ([5, 9, 9, 1, 9, 6, 9, 9, 9, 1, 9], [3, 3, 3, 4]),
    ],
)
def test_incident_breakdown(spark, form, p50s, triggers):
    t = spark.createDataFrame([("r", x) for x in triggers], "run STRING, time BIGINT")
    base = spark.createDataFrame([("r", 2)], "run STRING, baseline BIGINT")
    found = latency.incident_breakdown(timeline(spark, p50s), t, base)
    assert rows(found, "run", "duration", "max_p50") == sequential_incidents(p50s, triggers, 2)


def test_incident_example(spark, small):
    t = spark.createDataFrame([("r", 1)], "run STRING, time BIGINT")
    base = spark.createDataFrame([("r", 2)], "run STRING, baseline BIGINT")
    reported = spark.createDataFrame([("r", 5), ("r", 7), ("other", 1)], "run STRING, duration BIGINT")
    found = latency.incident_breakdown(timeline(spark, [1, 1, 9, 9, 1, 9, 1, 9]), t, base, reported)
    assert rows(found, "run", "duration", "max_p50", "reported_sum", "reported_max") == [("other", 0, 0, 1, 1), ("r", 2, 9, 12, 7)]


def test_result_logs(spark, small, tmp_path):
    for run, done in [("rate=100+native=True", True), ("rate=200+native=False", True), ("rate=300+native=True", False)]:
        folder = tmp_path / run
        folder.mkdir()
        (folder / "stdout.0").write_text(
            "bin_shift\t8\nstatm_RSS\t500000000\t4096\nlatency_ccdf\t100\t1\t3\nlatency_ccdf\t200\t0.05\t1\n"
            "summary_timeline\t0\t1\t2\t3\t4\t5\t6\t7\nmigration_done\t9\t5\ncontrol_time\t4\n"
        )
        if done:
            (folder / "done").write_text("")
    lines = logs.read_result_logs(spark, str(tmp_path))
    parsed = logs.parse_result_lines(lines)
    runs = ["rate=100+native=True", "rate=200+native=False"]
    assert rows(logs.memory_timeline(parsed)) == [(r, 0.5, 4096) for r in runs]
    assert rows(logs.ccdf_lines(parsed)) == [(r, *v) for r in runs for v in [(100, 1.0, 3), (200, 0.05, 1)]]
    assert rows(logs.timeline_lines(parsed)) == [(r, 0, 1, 2, 3, 4, 5, 6, 7) for r in runs]
    assert rows(logs.reported_lines(parsed)) == [(r, 9, 5) for r in runs]
    assert rows(logs.trigger_lines(parsed)) == [(r, 4) for r in runs]
    table = latency.ccdf_table(logs.ccdf_lines(parsed).withColumnRenamed("value", "bucket"))
    assert rows(table) == [(r, 200, None, None, 200) for r in runs]
    names = lines.select("run").distinct()
    assert rows(latency.experiment_params(names)) == [
        ("native", "False", "BOOLEAN", 2, False), ("native", "True", "BOOLEAN", 2, False),
        ("rate", "100", "BIGINT", 2, False), ("rate", "200", "BIGINT", 2, False),
    ]
    assert rows(latency.experiment_filter(names, {"native": "True"})) == [("rate=100+native=True",)]


def test_control_lines_without_moves_and_with_half_a_move(spark):
    lines = spark.createDataFrame([("D 100",), ("D 200 1 0",), ("M 300 2 3",)], "value string")
    parsed = logs.parse_control_lines(lines)
    assert sorted((r.ts, r.bin, r.worker) for r in parsed.collect()) == [(200, 1, 0), (300, 0, 2), (300, 1, 3)]
    with pytest.raises(Exception, match="a move without its worker"):
        logs.parse_control_lines(spark.createDataFrame([("D 100 1 0 3",)], "value string")).collect()


def test_messages_that_disagree_on_their_count(spark):
    control = spark.createDataFrame([(1, 5, 0, 2), (1, 5, 1, 1), (2, 6, 0, 1)], "ts long, sequence long, msg long, count long")
    assert [r.ts for r in routing.control_violations(control).collect()] == [1]


@pytest.mark.parametrize("intervals", [10**6, 0])
def test_records_that_no_map_routes(spark, monkeypatch, intervals):
    """An unknown bin, no bin and no time: dropped by both ways of routing."""
    monkeypatch.setattr(routing, "BROADCAST_INTERVALS", intervals)
    history = spark.createDataFrame([(0, 7, None, 10), (0, 8, 10, None)], "bin long, worker long, valid_from long, valid_to long")
    records = spark.createDataFrame([(1, 0, 5), (2, 0, 10), (3, 9, 5), (4, None, 5), (5, 0, None)], "id long, b long, at long")
    found = routing.distribute(records, F.col("b"), "at", history)
    assert sorted((r.id, r.worker) for r in found.collect()) == [(1, 7), (2, 8)]


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_history_is_written_once(spark):
    """Who reads a history does not parse its control log again."""
    lines = spark.createDataFrame([("M 100 0 1",), ("D 200 1 0",)], "value STRING")
    history = routing.control_history(logs.parse_control_lines(lines), routing.initial_map(spark, 2, 2))
    plan = history._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    assert sorted((r.bin, r.valid_from or 0, r.worker, r.valid_to) for r in history.collect()) == [
        (0, 0, 0, 100), (0, 100, 0, None), (1, 0, 1, 100), (1, 100, 1, 200), (1, 200, 0, None),
    ]


def test_moved_bins_in_slices_routes_once(spark):
    """In slices the plan reads what was counted, not the records for each of its parts."""
    history = spark.createDataFrame([(0, 0, None, 100), (0, 1, 100, None)], "bin BIGINT, worker BIGINT, valid_from BIGINT, valid_to BIGINT")
    records = spark.createDataFrame([(i, 90 + i) for i in range(20)], "id BIGINT, us BIGINT")
    small, size = "spark.bidflow.smallInputBytes", "spark.bidflow.sliceBytes"
    spark.conf.set(small, "0")
    spark.conf.set(size, "2000")
    try:
        found = routing.moved_bins(history, routing.distribute(records, F.lit(0).cast("bigint"), "us", history))
        assert rows(found) == [(100, 0, 0, 1, 10)]
        assert "us#" not in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(small)
        spark.conf.unset(size)


def test_incidents_in_slices_read_each_pass_once(spark):
    """Passes that follow each other do not multiply the reads of the input."""
    t, base = spark.createDataFrame([("r", 1)], "run STRING, time BIGINT"), spark.createDataFrame([("r", 2)], "run STRING, baseline BIGINT")
    line = timeline(spark, [1, 1, 9, 9, 1, 9, 1, 9])
    expected = rows(latency.incident_breakdown(line, t, base))
    small, size = "spark.bidflow.smallInputBytes", "spark.bidflow.sliceBytes"
    spark.conf.set(small, "0")
    spark.conf.set(size, "2000")
    try:
        found = latency.incident_breakdown(line, t, base)
        assert rows(found) == expected
        assert leaves(found) <= 6
    finally:
        spark.conf.unset(small)
        spark.conf.unset(size)
