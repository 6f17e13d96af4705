"""The auction model over the driver's tables, and the tagged event union."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The states people live in, in table order.
STATES = ["AZ", "CA", "ID", "OR", "WA", "WY"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def auctions_of(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS id",
        "CAST(round(o_totalprice * 100) AS BIGINT) div 10 AS initial_bid",
        "CAST(round(o_totalprice * 100) AS BIGINT) div 10 AS reserve",
        "o_orderdate AS date_time",
        "o_orderdate + INTERVAL '365' DAY AS expires",
        "o_custkey AS seller",
        "9 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS category",
    )


def bids_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "l_orderkey AS auction",
        "l_suppkey AS bidder",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS price",
        "l_shipdate AS date_time",
    )


def people_of(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Customers with their nation as city. Spark broadcasts the 25 nations by their size."""
    states = ", ".join(f"'{s}'" for s in STATES)
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey AS id",
        "c_name AS name",
        "n_name AS city",
        f"element_at(array({states}), CAST(c_nationkey % {len(STATES)} AS INT) + 1) AS state",
        "timestampadd(DAY, CAST(c_custkey % 2400 AS INT), TIMESTAMP_NTZ '1995-01-01 00:00:00') AS date_time",
    )


def clicks_of(events: DataFrame) -> DataFrame:
    """Event rows as bids with a sub-second event time."""
    return events.selectExpr(
        "event_id",
        "event_type",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS auction",
        "user_id AS bidder",
        "CAST(round(value * 100) AS BIGINT) AS price",
        "ts AS date_time",
    )


def words_of(events: DataFrame) -> DataFrame:
    """One word occurrence per event row: (event_id, ts, key, val = 1)."""
    return events.selectExpr(
        "event_id",
        "ts",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS key",
        "CAST(1 AS BIGINT) AS val",
    )


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auctions_of(table(spark, sf_dir, "orders"))


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bids_of(table(spark, sf_dir, "lineitem"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people_of(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks_of(table(spark, sf_dir, "events"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_of(table(spark, sf_dir, "events"))


def tagged_events(people: DataFrame, auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """One table of all events: a `type` tag and one filled struct per row."""
    person_t = people.select(F.struct("*").alias("s")).schema["s"].dataType.simpleString()
    auction_t = auctions.select(F.struct("*").alias("s")).schema["s"].dataType.simpleString()
    bid_t = bids.select(F.struct("*").alias("s")).schema["s"].dataType.simpleString()

    def variant(df, tag):
        def slot(name, type_name):
            value = F.struct(*df.columns) if name == tag else F.lit(None).cast(type_name)
            return value.alias(name.lower())

        return df.select(
            F.lit(tag).alias("type"), slot("Person", person_t), slot("Auction", auction_t), slot("Bid", bid_t)
        )

    return variant(people, "Person").unionByName(variant(auctions, "Auction")).unionByName(variant(bids, "Bid"))


def demux(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Splits a tagged event table (or stream) into people, auctions and bids."""

    def branch(tag):
        return events.where(F.col("type") == tag).select(f"{tag.lower()}.*")

    return branch("Person"), branch("Auction"), branch("Bid")
