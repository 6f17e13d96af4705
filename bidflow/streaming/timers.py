"""Timers with payload on streams: requests that are delivered when they are due, in due order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bidflow.streaming.folds import stateful_binary, stateful_unary

DELIVERED = "key BIGINT, id BIGINT, due_us BIGINT, position BIGINT"


def event_timers(
    requests: DataFrame, key: str, time: str, order: str, due: Column, payload: dict[str, str] | None = None,
    cancels: DataFrame | None = None, delay: str = "0 seconds",
) -> DataFrame:
    """key, id, due_us, position and the payload columns (name -> type) of every request, once its due time is past.

    `due` is in microseconds and not before the request's own time. A row of `cancels`, with the same key and
    time columns, drops the requests of its key that were made before it and are due after it. position counts
    a key's deliveries. Requests wait as typed rows in Spark's window state; a key's own state is two numbers.
    """
    payload, cancelling = payload or {}, cancels is not None
    output = ", ".join([DELIVERED, *[f"{name} {kind}" for name, kind in payload.items()]])
    made = requests.select(key, time, order, *[c for c in payload if c not in (key, order)], F.unix_micros(time).alias("made_us"), due.alias("due_us"))

    def deliver(of, due, seen, last, later):
        n = (seen.get() or (0,))[0]
        cancelled = last.get() if cancelling else None
        for us, row in due:
            if cancelled is None or row["made_us"] >= cancelled[0]:
                n += 1
                yield (of, row[order], us, n, *[row[c] for c in payload])
        seen.set((n,))

    if not cancelling:
        return stateful_unary(made, key, time, order, lambda of, due, seen, later: deliver(of, due, seen, None, later), output, due=F.col("due_us"), delay=delay)

    def cancel(of, due, seen, last, later):
        last.set((due[-1][0],))
        yield from ()

    return stateful_binary(
        made, cancels.select(key, time, F.lit(0).cast("bigint").alias("ord")), (key, key), (time, time), (order, "ord"), (deliver, cancel), output,
        dues=(F.col("due_us"), None), delay=delay,
    )
