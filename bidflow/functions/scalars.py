"""Scalar column expressions: slots, bins, histogram buckets, conversions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NTZ_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def micros_of(ts: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, independent of the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {NTZ_EPOCH}, `{ts}`)")


def ntz_of(micros: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, `{micros}`, {NTZ_EPOCH})")


def slot_end(time: str, width: int) -> Column:
    """End of the slot a BIGINT time falls into: slots are [k * width, (k + 1) * width)."""
    return F.expr(f"(`{time}` div {width} + 1) * {width}")


def to_euro_cents(price: str) -> Column:
    """Price at 89 / 100, truncated."""
    return F.expr(f"`{price}` * 89 div 100")


def truncated_mean(total: str, count: str) -> Column:
    return F.expr(f"`{total}` div `{count}`")


def bin_of_hash(key: str, shift: int) -> Column:
    """Top `shift` bits of a 64-bit hash of the key; `shift` = 0 means a single bin."""
    if shift == 0:
        return F.lit(0).cast("bigint")
    return F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - shift).cast("bigint")


def bin_of_dense(key: str, shift: int) -> Column:
    """Low `shift` bits of a dense non-negative integer key."""
    return (F.col(key) % (1 << shift)).cast("bigint")


def log2_floor(value: str) -> Column:
    return F.expr(f"CAST(length(bin(`{value}`)) - 1 AS INT)")


def histogram_bucket(value: str) -> Column:
    """Lower bound of the log-linear bucket: 16 sub-buckets per power of two, exact below 16."""
    e = f"CAST(length(bin(`{value}`)) - 1 AS INT)"
    return F.expr(
        f"CASE WHEN `{value}` < 16 THEN `{value}` "
        f"ELSE shiftleft(CAST(1 AS BIGINT), {e}) "
        f"+ shiftleft(shiftright(`{value}`, {e} - 4) & CAST(15 AS BIGINT), {e} - 4) END"
    )


def event_time() -> Column:
    """Time of a tagged event row: the time of its filled variant."""
    return F.coalesce("person.date_time", "auction.date_time", "bid.date_time")


def event_key() -> Column:
    """Key of a tagged event row. Bids have no id of their own: their key is the auction."""
    return F.coalesce("person.id", "auction.id", "bid.auction")


def two_longs(first: Column, second: Column) -> Column:
    """Two integers as one decimal in the order of (first, second), the first below 10**17 in size.

    The maximum of a decimal is a hash aggregate, that of a struct sorts its input.
    """
    return (
        first.cast("decimal(17,0)") * F.lit("100000000000000000000").cast("decimal(21,0)")
        + (second.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)"))
    ).cast("decimal(38,0)")


def first_long(packed: str) -> Column:
    return F.floor(F.col(packed) / F.lit("100000000000000000000").cast("decimal(21,0)")).cast("bigint")


def second_long(packed: str) -> Column:
    rest = F.pmod(F.col(packed), F.lit("100000000000000000000").cast("decimal(21,0)"))
    return (rest - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("bigint")
