"""The auction queries as streaming plans.

Inputs are streams with the columns of `bidflow.sources.tables`, but event times as TIMESTAMP
(watermarks need that type): use `with_timestamps`. Stateless queries (`q0`, `q1`, `q2`) and
`demux` are the batch functions, applied to streams as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bidflow.plans.auctions import CATEGORY, LAST_N, STATES
from bidflow.streaming.folds import state_machine, stateful_binary, stateful_unary
from bidflow.streaming.runs import END_OF_TIME_US


def with_timestamps(df: DataFrame) -> DataFrame:
    """Casts TIMESTAMP_NTZ columns; keep the session time zone on UTC for these."""
    casts = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def q3(auctions: DataFrame, people: DataFrame) -> DataFrame:
    """Symmetric join with full history: neither side can be forgotten, as a match may come at any time."""
    items = auctions.where(F.col("category") == CATEGORY).select(F.col("id").alias("auction"), "seller")
    locals_ = people.where(F.col("state").isin(STATES)).select(F.col("id").alias("person"), "name", "city", "state")
    return items.join(locals_, F.col("seller") == F.col("person")).select("name", "city", "state", "auction")


def q7(bids: DataFrame, window_seconds: int = 10, delay: str = "0 seconds") -> DataFrame:
    return (
        bids.withWatermark("date_time", delay)
        .groupBy(F.window("date_time", f"{window_seconds} seconds").alias("_w"))
        .agg(F.max("price").alias("price"))
        .select(F.col("_w.end").alias("window_end"), "price")
    )


def q5(bids: DataFrame, slices: int = 60, slide_seconds: int = 1, delay: str = "0 seconds") -> DataFrame:
    """Slot counts, then sliding sums of slot counts, then the best auction per window."""
    slots = (
        bids.withWatermark("date_time", delay)
        .groupBy(F.window("date_time", f"{slide_seconds} seconds").alias("_slot"), "auction")
        .agg(F.count(F.lit(1)).alias("bids"))
    )
    sliding = F.window(F.window_time("_slot"), f"{slices * slide_seconds} seconds", f"{slide_seconds} seconds")
    counts = slots.groupBy(sliding.alias("_w"), "auction").agg(F.sum("bids").alias("bids"))
    return (
        counts.groupBy("_w")
        .agg(F.max(F.struct("bids", "auction")).alias("top"))
        .select(F.col("_w.end").alias("window_end"), F.col("top.auction").alias("auction"), F.col("top.bids").alias("bids"))
    )


def q8(auctions: DataFrame, people: DataFrame, window_seconds: int = 12 * 3600, delay: str = "0 seconds") -> DataFrame:
    """Interval join; the watermarks let both sides forget what can no longer match."""
    opened = auctions.select("seller", F.col("date_time").alias("opened")).withWatermark("opened", delay)
    joined = people.select(F.col("id").alias("person"), F.col("date_time").alias("joined")).withWatermark("joined", delay)
    soon = F.expr(
        f"seller = person AND opened >= joined AND opened < joined + INTERVAL '{window_seconds}' SECOND"
    )
    return opened.join(joined, soon).select("seller")


#: A bid waits for its auction until the end of its slot of this length.
SLOT_SECONDS = 86_400

CLOSED = (
    "id BIGINT, seller BIGINT, category BIGINT, initial_bid BIGINT, reserve BIGINT, opened_us BIGINT,"
    " expires_us BIGINT, bidder BIGINT, price BIGINT, bid_us BIGINT"
)


def closed_auctions(auctions: DataFrame, bids: DataFrame, delay: str = "0 seconds", slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Each auction with its winning bid, emitted once the watermark has passed its expiry. Native operators only.

    An auction is a session of its id from its opening to its expiry, a bid one from its time to the end of its slot, so
    a bid and the auctions it falls into are always in one session, which is one row of state and is emitted and dropped
    when it is over. The exact conditions are applied inside it: sessions may hold bids of no auction, and several
    auctions of one id. The bids of a session are in memory together. A longer slot lets auctions and bids of an
    auction come later behind the watermark, and results wait at most for the end of the slot of the last bid.
    """

    def watched(rows):
        # The row that ends a stream moves the watermark and is no auction or bid. The filter names the watched column, which
        # keeps it above the node that watches.
        return rows.withWatermark("at", delay).where((F.unix_micros("at") < END_OF_TIME_US) & F.col("auction").isNotNull())

    terms = F.struct("seller", "category", "initial_bid", "reserve", F.unix_micros("expires").alias("expires_us"))
    opened = auctions.select(F.col("id").alias("auction"), F.col("date_time").alias("at"), terms.alias("terms"))
    offers = bids.select("auction", F.col("date_time").alias("at"), "bidder", "price")
    # Rows are shuffled before sessions and lists are made of them, which are more bytes.
    merged = watched(opened).unionByName(watched(offers), allowMissingColumns=True).repartition("auction")
    length, us, is_bid = slot_seconds * 1_000_000, F.unix_micros("at"), F.col("terms").isNull()
    wait_us = F.when(is_bid, length - F.pmod(us, F.lit(length))).otherwise(F.col("terms.expires_us") - us)
    wait = F.make_interval(secs=(wait_us.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
    met = merged.groupBy("auction", F.session_window("at", wait)).agg(
        F.collect_set(F.when(~is_bid, F.struct("terms.*", us.alias("opened_us")))).alias("opened"),
        F.collect_list(F.when(is_bid, F.struct("price", us.alias("bid_us"), "bidder"))).alias("offers"),
    )

    def best(a):
        valid = F.filter("offers", lambda b: (a["opened_us"] <= b["bid_us"]) & (b["bid_us"] < a["expires_us"]) & (b["price"] >= a["reserve"]))
        return F.array_min(F.transform(valid, lambda b: F.struct((-b["price"]).alias("minus_price"), b["bid_us"].alias("bid_us"), b["bidder"].alias("bidder"))))

    won = met.select("auction", F.explode(F.transform("opened", lambda a: F.struct(a.alias("a"), best(a).alias("best")))).alias("w")).where("w.best IS NOT NULL")
    return won.select(
        F.col("auction").alias("id"), *[f"w.a.{c}" for c in ("seller", "category", "initial_bid", "reserve", "opened_us", "expires_us")],
        "w.best.bidder", (-F.col("w.best.minus_price")).alias("price"), "w.best.bid_us",
    )


def closed_log(closed: DataFrame) -> DataFrame:
    """Closed auctions as replayed from their log: ordered by expiry in what follows."""
    return closed.select("id", "category", "bidder", "price", F.timestamp_micros("expires_us").alias("expires"))


def q4_running(closed: DataFrame, delay: str = "0 seconds") -> DataFrame:
    def fold(category, row, state):
        total, n = state or (0, 0)
        total, n = total + row["price"], n + 1
        return False, (total, n), [(row["id"], category, total // n)]

    return state_machine(
        closed.select("id", "category", "price", "expires"), "category", "expires", "id", fold, "id BIGINT, category BIGINT, avg_price BIGINT", "total BIGINT, n BIGINT", delay
    )


def q6(closed: DataFrame, n: int = LAST_N, delay: str = "0 seconds") -> DataFrame:
    def fold(bidder, due, state, later):
        for _, row in due:
            state.replace((state.items() + [(row["price"],)])[-n:])
            prices = [item[0] for item in state.items()]
            yield (row["id"], bidder, sum(prices) // len(prices))

    return stateful_unary(
        closed.select("id", "bidder", "price", "expires"), "bidder", "expires", "id", fold, "id BIGINT, bidder BIGINT, avg_price BIGINT", items="price BIGINT", delay=delay
    )


def latest_match_join(left: DataFrame, right: DataFrame, key: str, time: str, order: str, delay: str = "0 seconds") -> DataFrame:
    """Right rows with the latest left row of their key; early ones wait for the first left row.

    Returns (key, left_id, right_id), the ids being the order columns.
    """

    def on_left(k, due, latest, waiting, later):
        for _, row in due:
            early = waiting.items()
            if early:
                yield from [(k, row[order], item[0]) for item in early]
                waiting.replace([])
            latest.set((row[order],))

    def on_right(k, due, latest, waiting, later):
        found = latest.get()
        for _, row in due:
            if found is None:
                waiting.append((row[order],))
            else:
                yield (k, found[0], row[order])

    return stateful_binary(
        left, right, (key, key), (time, time), (order, order), (on_left, on_right),
        "key BIGINT, left_id BIGINT, right_id BIGINT", values=("id BIGINT", "v BIGINT"), items=("v BIGINT", "id BIGINT"), delay=delay,
    )
