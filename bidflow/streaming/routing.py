"""Routing of a stream of records by a stream of control instructions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from bidflow.streaming.folds import SLOT_SECONDS, Fold


def distribute(
    records: DataFrame, bin_of: Column, time: str, order: str, control: DataFrame, initial: Callable[[int], int | None],
    salts: int = 16, delay: str = "0 seconds", slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Each record with bin, worker and valid_from_us of the map version in force at its time, once control has passed it.

    control (at TIMESTAMP, bin, worker, order BIGINT) is a stream of assignments; at one time the last by order
    counts, and it counts for records of that time. `initial(bin)` is the worker before the first assignment;
    None drops such records, as records without a bin are. Records wait until the watermarks of both streams are
    past the slot of their time, with the assignments of their bin and slot, each held once, and find their version
    there. What a slot hands to later ones is its last assignment; only that is repeated over the `salts` keys
    that a bin's records are dealt over. A longer slot repeats less and waits longer. The time comes back as `us`.
    """
    columns = [c for c in records.columns if c != time]
    own = F.struct(
        F.pmod(F.xxhash64(order), F.lit(salts)).cast("int").alias("salt"), F.unix_micros(time).alias("us"),
        F.col(order).cast("bigint").alias("ord"), F.struct(*columns).alias("row"),
    )
    version = F.struct(F.unix_micros("at").alias("us"), F.col("order").cast("bigint").alias("ord"), F.col("worker").cast("bigint").alias("worker"))
    kept = records.select(bin_of.cast("bigint").alias("bin"), F.col(time).alias("_at"), own.alias("record"))
    known = control.select(F.col("bin").cast("bigint").alias("bin"), F.col("at").alias("_at"), version.alias("version"))
    merged = kept.withWatermark("_at", delay).unionByName(known.withWatermark("_at", delay), allowMissingColumns=True)
    # Sorted here, below the node that explodes, so that it happens once per slot.
    versions = F.collect_list("version")
    powers = F.array(*[F.lit(1 << b) for b in reversed(range(31))])
    slots = merged.groupBy("bin", F.window("_at", f"{slot_seconds} seconds").alias("_slot")).agg(
        F.collect_list("record").alias("records"), F.sort_array(versions).alias("versions"),
        F.filter(powers, lambda s: s <= F.size(versions)).alias("steps"),
    )

    def last_by(us):
        """The last of the slot's versions up to a time, by binary search; null if there is none."""
        def step(at, width):
            ahead = at + width
            return F.when((ahead <= F.size("versions")) & (F.get("versions", ahead - 1)["us"] <= us), ahead).otherwise(at)

        return F.get("versions", F.aggregate("steps", F.lit(0), step) - 1)

    def routed(r):
        row = F.struct(r["row"].alias("row"), last_by(r["us"]).alias("version"))
        return F.struct(
            r["salt"].alias("salt"), r["us"].alias("us"), F.lit(2).alias("input"), r["ord"].alias("ord"),
            F.lit(None).cast("struct<worker:bigint>").alias("r1"), F.when(r["us"].isNotNull(), row).alias("r2"),
        )

    dealt = F.transform("records", routed)
    kind = slots.select(dealt.alias("r")).schema["r"].dataType
    last = F.try_element_at("versions", F.lit(-1))

    def handed(salt):
        return F.struct(salt, last["us"], F.lit(1), last["ord"], F.struct(last["worker"]), F.lit(None))

    repeated = F.transform(F.when(F.size("versions") > 0, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array().cast("array<int>")), handed)
    single = slots.select("bin", F.explode(F.concat(dealt, repeated.cast(kind))).alias("r"))
    # Rows without a bin go to a key of their own that has no initial worker.
    key = F.coalesce(F.col("bin") * salts + F.col("r.salt"), F.lit(-1))
    keyed = single.select(key.alias("key"), F.array("r").alias("records"))

    def assign(key, due, version, unused, later):
        us, row = due[-1]
        version.set((row["worker"], us))
        yield from ()

    def route(key, due, version, unused, later):
        if key < 0:
            return
        number = key // salts
        for us, row in due:
            found = row["version"]
            at = (found["worker"], found["us"]) if found else version.get() or (initial(number), None)
            if found or at[1] is not None or at[0] is not None:
                yield (*[row["row"][c] for c in columns], us, number, *at)

    types = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    output = ", ".join([*[f"`{c}` {types[c]}" for c in columns], "us BIGINT, bin BIGINT, worker BIGINT, valid_from_us BIGINT"])
    names = [["worker"], ["row", "version"]]
    fold = Fold(
        [assign, route], ["worker BIGINT, us BIGINT", "v BIGINT"], ["v BIGINT", "v BIGINT"], [None, None], names,
        StructType.fromDDL(output).fieldNames(), [False, False],
    )
    return keyed.groupBy("key").transformWithState(
        statefulProcessor=fold, outputStructType=StructType.fromDDL(output), outputMode="Append", timeMode="EventTime"
    )
