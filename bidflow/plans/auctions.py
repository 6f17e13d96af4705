"""The auction queries as functions from DataFrames to DataFrames.

Inputs have the columns of `bidflow.sources.tables`. Auction and person ids are unique. Prices are
integer cents and every average is a truncating integer division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bidflow.functions.scalars import first_long, micros_of, second_long, to_euro_cents, truncated_mean, two_longs
from bidflow.operators.changelog import consolidate
from bidflow.operators.ordered import last_n_sums, running
from bidflow.operators.skew import balanced_join

# Fixed values of the query definitions.
SKIP = 123
CATEGORY = 10
STATES = ["OR", "ID", "CA"]
LAST_N = 10


# -- stateless -----------------------------------------------------------------------------------


def q0(events: DataFrame) -> DataFrame:
    return events.select("*")


def q1(bids: DataFrame) -> DataFrame:
    return bids.select("auction", "bidder", to_euro_cents("price").alias("price"), "date_time")


def q2_auctions(skip: int = SKIP):
    return F.col("auction") % skip == 0


def q2(bids: DataFrame, skip: int = SKIP) -> DataFrame:
    return bids.where(q2_auctions(skip)).select("auction", "price")


# -- q3: local item suggestion -------------------------------------------------------------------


def _q3_sides(auctions, people):
    items = auctions.where(F.col("category") == CATEGORY)
    locals_ = people.where(F.col("state").isin(STATES))
    return items, locals_


def q3(auctions: DataFrame, people: DataFrame) -> DataFrame:
    items, sellers = _q3_sides(auctions, people)
    pairs = balanced_join(
        items.select(F.col("id").alias("auction"), "seller"),
        sellers.select(F.col("id").alias("person"), "name", "city", "state"),
        "seller",
        "person",
    )
    return pairs.select("name", "city", "state", "auction")


def q3_latest(auctions: DataFrame, people: DataFrame) -> DataFrame:
    """A person meets every later auction, but only the latest of the auctions already there.

    "Latest at or before" is a maximum per person, so it is aggregated (and combined before any
    shuffle) instead of being looked up in an ordered list of the seller's auctions. Later auctions
    go through the same aggregation as groups of their own: one join, one pass.
    """
    items, sellers = _q3_sides(auctions, people)
    pairs = balanced_join(
        items.select(F.col("id").alias("auction"), "seller", F.col("date_time").alias("opened")),
        sellers.select(F.col("id").alias("person"), "name", "city", "state", F.col("date_time").alias("joined")),
        "seller",
        "person",
    )
    own_group = F.when(F.col("opened") > F.col("joined"), F.col("auction"))
    return (
        pairs.groupBy("person", own_group.alias("_later"), "name", "city", "state")
        .agg(F.max(two_longs(micros_of("opened"), F.col("auction"))).alias("last"))
        .select("name", "city", "state", second_long("last").alias("auction"))
    )


def q3_semijoin(auctions: DataFrame, people: DataFrame, key: str = "seller") -> DataFrame:
    """People with at least one auction of the category; `key` = "id" matches auction ids instead.

    Keys are made distinct first, so a seller with very many auctions arrives as one row per task.
    """
    items, locals_ = _q3_sides(auctions, people)
    keys = items.select(F.col(key).alias("_key")).distinct()
    return locals_.join(keys, F.col("id") == F.col("_key"), "left_semi").select("id", "name", "state", "city")


# -- closed auctions, q4, q6 ---------------------------------------------------------------------


def closed_auctions(auctions: DataFrame, bids: DataFrame, lower_bound: bool = True) -> DataFrame:
    """Auctions with their winning bid: highest price, then earliest bid, then smallest bidder.

    The winner is a minimum over one struct, so each task sends on a single candidate per auction.
    """
    carried = ["seller", "category", "initial_bid", "reserve", "date_time", "expires"]
    valid = (F.col("bid_time") < F.col("expires")) & (F.col("price") >= F.col("reserve"))
    if lower_bound:
        valid = valid & (F.col("date_time") <= F.col("bid_time"))
    offers = bids.select("auction", "bidder", "price", F.col("date_time").alias("bid_time"))
    pairs = balanced_join(offers, auctions.select("id", *carried), "auction", "id", valid)
    rank = F.struct((-F.col("price")).alias("minus_price"), "bid_time", "bidder", *carried)
    return (
        pairs.groupBy("id")
        .agg(F.min(rank).alias("w"))
        .select(
            "id",
            *[F.col(f"w.{c}").alias(c) for c in carried],
            F.col("w.bidder").alias("bidder"),
            (-F.col("w.minus_price")).alias("price"),
            F.col("w.bid_time").alias("bid_time"),
        )
    )


def q4_sum_count(closed: DataFrame) -> DataFrame:
    return closed.groupBy("category").agg(
        F.sum("price").alias("total"), F.count(F.lit(1)).alias("auctions")
    )


def q4(closed: DataFrame) -> DataFrame:
    return q4_sum_count(closed).select("category", truncated_mean("total", "auctions").alias("avg_price"))


def q4_running(closed: DataFrame) -> DataFrame:
    """The category's average so far, one row per closed auction in closing order."""
    steps = running(
        closed.select("id", "category", "expires", "price"),
        ["category"],
        ["expires", "id"],
        rank="_n",
        sums={"_total": F.col("price")},
    )
    return steps.select("id", "category", "expires", truncated_mean("_total", "_n").alias("avg_price"))


def q6(closed: DataFrame, n: int = LAST_N) -> DataFrame:
    """Average of the bidder's last `n` winning prices, one row per closed auction."""
    steps = last_n_sums(
        closed.select("id", "bidder", "expires", "price"),
        ["bidder"],
        ["expires", "id"],
        n,
        {"_total": F.col("price"), "_n": F.lit(1).cast("bigint")},
    )
    return steps.select("id", "bidder", "expires", truncated_mean("_total", "_n").alias("avg_price"))


def q6_seller(closed: DataFrame, n: int = LAST_N) -> DataFrame:
    """Per seller, average over the newest `n` distinct (expires, price).

    `row_number <= n` lets Spark keep only n rows per seller and task before the shuffle.
    """
    newest = Window.partitionBy("seller").orderBy(F.col("expires").desc(), F.col("price").desc())
    return (
        closed.select("seller", "expires", "price")
        .distinct()
        .withColumn("_newest", F.row_number().over(newest))
        .where(F.col("_newest") <= n)
        .groupBy("seller")
        .agg(F.expr("sum(price) div count(*)").alias("avg_price"))
    )


# -- windows: q5, q7 -----------------------------------------------------------------------------


def _seconds(n: int):
    return F.expr(f"make_dt_interval(0, 0, 0, {n})")


# Microseconds of a time and back, for both timestamp types.
_MICROS = {
    "timestamp_ntz": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {})",
    "timestamp": "unix_micros({})",
}
_TIME_OF = {
    "timestamp_ntz": "timestampadd(MICROSECOND, {}, TIMESTAMP_NTZ '1970-01-01 00:00:00')",
    "timestamp": "timestamp_micros({})",
}


def slot_counts(bids: DataFrame, slide_seconds: int = 1) -> DataFrame:
    """Bids per (slot, auction): the only step that touches single bids."""
    return (
        bids.groupBy(F.window("date_time", f"{slide_seconds} seconds").alias("_slot"), "auction")
        .agg(F.count(F.lit(1)).alias("bids"))
        .select(F.col("_slot.end").alias("slot_end"), "auction", "bids")
    )


def sliding_counts(bids: DataFrame, slices: int = 60, slide_seconds: int = 1) -> DataFrame:
    """Bids per (window_end, auction), for all windows an auction has bids in.

    Time is cut into chunks of one window length. A slot's count matters in its own chunk, where it
    is added, and in the next one, where it is there from the start and then falls out. So three
    signed rows per slot count are shuffled instead of one row per window, and a group is one
    auction in one chunk: at most 2 * slices + 1 rows, whatever the auction. The running count only
    changes at those rows; between them it is repeated per window, after the shuffle.
    """
    micros = slide_seconds * 1_000_000
    n = slices
    slots = slot_counts(bids, slide_seconds)
    kind = slots.schema["slot_end"].dataType.simpleString()
    to_slot = f"{_MICROS[kind].format('slot_end')} div {micros}"
    numbered = slots.selectExpr("auction", "bids", f"{to_slot} AS _t").withColumn(
        "_chunk", F.expr(f"(_t - pmod(_t, {n})) div {n}")
    )
    changes = F.array(
        F.struct(F.col("_chunk").alias("chunk"), F.col("_t").alias("t"), F.col("bids").alias("diff")),
        F.struct((F.col("_chunk") + 1).alias("chunk"), ((F.col("_chunk") + 1) * n).alias("t"), F.col("bids").alias("diff")),
        F.struct((F.col("_chunk") + 1).alias("chunk"), (F.col("_t") + n).alias("t"), (-F.col("bids")).alias("diff")),
    )
    per_time = (
        numbered.select("auction", F.explode(changes).alias("c"))
        .select("auction", "c.*")
        .repartition("auction", "chunk")
        .groupBy("auction", "chunk", "t")
        .agg(F.sum("diff").alias("diff"))
    )
    in_chunk = Window.partitionBy("auction", "chunk").orderBy("t")
    steps = per_time.select(
        "auction",
        "t",
        F.sum("diff").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0)).alias("bids"),
        F.coalesce(F.lead("t").over(in_chunk), (F.col("chunk") + 1) * n).alias("_until"),
    )
    return (
        steps.where("bids > 0")
        .select("auction", "bids", F.explode(F.sequence("t", F.col("_until") - 1)).alias("_end"))
        .select(F.expr(_TIME_OF[kind].format(f"_end * {micros}")).alias("window_end"), "auction", "bids")
    )


def _busiest(counts: DataFrame, keys: list[str]) -> DataFrame:
    top = F.max(two_longs(F.col("bids"), F.col("auction"))).alias("top")
    return counts.groupBy(*keys).agg(top).select(*keys, second_long("top").alias("auction"), first_long("top").alias("bids"))


def q5(bids: DataFrame, slices: int = 60, slide_seconds: int = 1) -> DataFrame:
    """Per sliding window the auction with most bids; on a tie the largest id."""
    return _busiest(sliding_counts(bids, slices, slide_seconds), ["window_end"])


def q5_local(bids: DataFrame, peers: int, slices: int = 60, slide_seconds: int = 1) -> DataFrame:
    counts = sliding_counts(bids, slices, slide_seconds).withColumn("peer", F.col("auction") % peers)
    return _busiest(counts, ["window_end", "peer"])


def q7(bids: DataFrame, window_seconds: int = 10) -> DataFrame:
    return (
        bids.groupBy(F.window("date_time", f"{window_seconds} seconds").alias("_w"))
        .agg(F.max("price").alias("price"))
        .select(F.col("_w.end").alias("window_end"), "price")
    )


def q7_argmax(bids: DataFrame, window_seconds: int = 10) -> DataFrame:
    """The whole highest bid; ties by earliest time, then smallest auction and bidder."""
    rank = F.struct((-F.col("price")).alias("minus_price"), "date_time", "auction", "bidder")
    return (
        bids.groupBy(F.window("date_time", f"{window_seconds} seconds").alias("_w"))
        .agg(F.min(rank).alias("top"))
        .select(
            F.col("_w.end").alias("window_end"),
            F.col("top.auction").alias("auction"),
            (-F.col("top.minus_price")).alias("price"),
            F.col("top.bidder").alias("bidder"),
        )
    )


# -- q8: monitor new users -----------------------------------------------------------------------


def q8(auctions: DataFrame, people: DataFrame, window_seconds: int = 12 * 3600) -> DataFrame:
    """Sellers once per auction they opened within `window_seconds` of signing up."""
    opened = auctions.select("seller", F.col("id").alias("auction"), F.col("date_time").alias("opened"))
    joined = people.select(F.col("id").alias("person"), F.col("date_time").alias("joined"))
    soon = (F.col("opened") >= F.col("joined")) & (F.col("opened") < F.col("joined") + _seconds(window_seconds))
    return balanced_join(opened, joined, "seller", "person", soon).select("seller")


def q8_as_written(auctions: DataFrame, window_seconds: int = 12 * 3600) -> DataFrame:
    """The same with auctions standing in for people (their ids matched against sellers)."""
    return q8(auctions, auctions.select("id", "date_time"), window_seconds)


def q8_changelog(auctions: DataFrame, people: DataFrame, window_seconds: int = 12 * 3600) -> DataFrame:
    """Signed form: a person is present from sign-up until one window later, an auction for good."""
    opened = auctions.select("seller", F.col("id").alias("auction"), "reserve", F.col("date_time").alias("opened"))
    joined = people.select(F.col("id").alias("person"), "name", F.col("date_time").alias("joined"))
    # A pair whose auction opens after the person left would add and remove a row at one time.
    present = F.col("opened") < F.col("joined") + _seconds(window_seconds)
    pairs = balanced_join(opened, joined, "seller", "person", present)
    signs = F.array(
        F.struct(F.greatest("joined", "opened").alias("time"), F.lit(1).cast("bigint").alias("diff")),
        F.struct(
            F.greatest(F.col("joined") + _seconds(window_seconds), F.col("opened")).alias("time"),
            F.lit(-1).cast("bigint").alias("diff"),
        ),
    )
    signed = pairs.select(F.col("person").alias("id"), "name", "reserve", F.explode(signs).alias("s"))
    return consolidate(signed.select("id", "name", "reserve", "s.time", "s.diff"))
