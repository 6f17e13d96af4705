"""Relations between queries, and independence from row order and file layout."""

import pytest
from pyspark.sql import functions as F

from bidflow.operators import changelog
from bidflow.plans import auctions as q
from bidflow.plans import words as w
from bidflow.sources import logs, tables


def equal(a, b):
    return changelog.verify_equal(a, b.select(*a.columns)).count() == 0


def test_changelog_accumulates_to_window_counts(spark, sf_dir):
    clicks = tables.clicks(spark, sf_dir)
    counts = q.sliding_counts(clicks, 24, 3600)
    changes = changelog.sliding_changelog(q.slot_counts(clicks, 3600), 24, 3600)
    ends = counts.select("window_end").distinct()
    # Small test data: every change against every later window end.
    summed = (
        changes.join(ends, F.col("time") <= F.col("window_end"))
        .groupBy("window_end", "auction").agg(F.sum("diff").alias("bids")).where("bids > 0")
    )
    assert equal(counts, summed)


def test_q5_is_best_of_q5_local(spark, sf_dir):
    clicks = tables.clicks(spark, sf_dir)
    local = q.q5_local(clicks, 4, 24, 3600)
    best = local.groupBy("window_end").agg(F.max(F.struct("bids", "auction")).alias("t")).select("window_end", "t.auction", "t.bids")
    assert equal(q.q5(clicks, 24, 3600), best)


def test_last_running_average_is_the_average(spark, sf_dir, small):
    closed = q.closed_auctions(tables.auctions(spark, sf_dir), tables.bids(spark, sf_dir))
    last = q.q4_running(closed).groupBy("category").agg(F.max_by("avg_price", F.struct("expires", "id")).alias("avg_price"))
    assert equal(q.q4(closed), last)


def test_last_running_count_is_the_count(spark, sf_dir):
    words = tables.words(spark, sf_dir)
    last = w.word_count_running(words, ["ts", "event_id"]).groupBy("key").agg(F.max("total").alias("total"))
    assert equal(w.word_count(words), last)


@pytest.mark.parametrize("query", ["q5", "q7_argmax", "closed", "running"])
def test_row_order_and_files_do_not_matter(spark, sf_dir, tmp_path, query, small):
    def split(df, name):
        path = str(tmp_path / name)
        df.repartition(7, F.rand(3)).write.parquet(path)
        return spark.read.parquet(path)

    def run(change):
        if query == "q5":
            return q.q5(change(tables.clicks(spark, sf_dir), "c"), 24, 3600)
        if query == "q7_argmax":
            return q.q7_argmax(change(tables.clicks(spark, sf_dir), "c"), 3600)
        if query == "closed":
            return q.closed_auctions(change(tables.auctions(spark, sf_dir), "a"), change(tables.bids(spark, sf_dir), "b"))
        return w.word_count_running(change(tables.words(spark, sf_dir), "w"), ["ts", "event_id"])

    assert equal(run(lambda df, name: df), run(split))


def test_event_log_round_trip(spark, sf_dir, tmp_path):
    people, auctions, bids = tables.people(spark, sf_dir), tables.auctions(spark, sf_dir), tables.bids(spark, sf_dir)
    path = str(tmp_path / "log")
    logs.capture(tables.tagged_events(people, auctions, bids), path)
    p, a, b = tables.demux(logs.replay(spark, path))
    assert equal(people, p) and equal(auctions, a) and equal(bids, b)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = q.q2(tables.bids(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan


@pytest.mark.parametrize("name", ["q3", "closed_auctions", "q5", "q8", "distribute", "latest_match_join", "latency_timeline"])
def test_no_products_in_plans(spark, sf_dir, name, form):
    from bidflow.plans.registry import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
