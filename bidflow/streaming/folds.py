"""Keyed folds over event time, on native windows and `transformWithState`.

All operators share one rule: a record is folded only once the watermark has passed the slot of its due time,
and a key's records are folded in order of (due time, input, order column). Results therefore do not depend on
how the stream was cut into micro-batches. A record's due time is its event time unless an expression says
otherwise, and folds may schedule further records for later.

Records wait as typed rows in the state of a window aggregation by key and slot, which Spark keeps, evicts and
hands on in the JVM; only due records reach Python. Records that a fold schedules wait in typed map state
by due time, with a timer at the end of each slot that has some. A key's records of one trigger are in memory
together; `files_per_trigger` bounds a trigger. A key's fold is sequential by definition; use
`bidflow.operators.ordered` where the fold is a sum, a maximum or a last value and the input is a table.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Records wait together in slots of this length. It decides when they are folded, never in which order.
SLOT_SECONDS = 60


class KeyState:
    """What a fold sees of one input's state for the current key: a value and a list.

    The store is read at most once and written at most once per trigger and key.
    """

    def __init__(self, value, items):
        self._value, self._items = value, items
        self.begin()

    def begin(self) -> None:
        self._loaded = self._listed = self._set = self._put = False
        self._current, self._list, self._added = None, None, []

    def get(self) -> tuple | None:
        if not self._loaded:
            self._loaded, self._current = True, self._value.get()
        return self._current

    def set(self, value: tuple | None) -> None:
        self._loaded = self._set = True
        self._current = value

    def items(self) -> list[tuple]:
        if not self._listed:
            self._listed, self._list = True, list(self._items.get()) + self._added
        return self._list

    def append(self, *items: tuple) -> None:
        self._added += items
        if self._listed:
            self._list += items

    def replace(self, items: list[tuple]) -> None:
        self._listed = self._put = True
        self._list, self._added = list(items), []

    def clear(self) -> None:
        self.set(None)
        self.replace([])

    def flush(self) -> None:
        if self._set and self._current is None:
            self._value.clear()
        elif self._set:
            self._value.update(self._current)
        if self._put and self._list:
            self._items.put(self._list)
        elif self._put:
            self._items.clear()
        elif self._added:
            self._items.appendList(self._added)
        self.begin()


class Later:
    """Collects records a fold schedules for its own input, and cancels those that wait.

    `at(due_us, row)` takes a dict with the columns of the input; a column left out is null. `cancel(test)`
    drops the waiting records (due_us, row) of the key and input for which the test holds.
    """

    def __init__(self, number: int, at_us: int, names: list[str]):
        self.input, self.now, self.names = number, at_us, names
        self.added: list[tuple[int, int, int, Any]] = []
        self.cancelled: list[Callable] = []

    def at(self, due_us: int, row: dict, order: int = 0) -> None:
        self.added.append((max(due_us, self.now), self.input, order, {name: row.get(name) for name in self.names}))

    def cancel(self, test: Callable[[int, Any], bool]) -> None:
        self.added = [r for r in self.added if not test(r[0], r[3])]
        self.cancelled.append(test)


class Fold(StatefulProcessor):
    def __init__(self, folds, value_schemas, item_schemas, record_schemas, names, output_fields, schedules):
        self.folds, self.schedules, self.names = folds, schedules, names
        self.value_schemas, self.item_schemas, self.record_schemas = value_schemas, item_schemas, record_schemas
        self.output_fields = output_fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = [
            KeyState(handle.getValueState(f"value{i}", v), handle.getListState(f"items{i}", t))
            for i, (v, t) in enumerate(zip(self.value_schemas, self.item_schemas), 1)
        ]
        key = "due_us BIGINT, ord BIGINT, n BIGINT"
        self.waiting = [
            handle.getMapState(f"waiting{i}", key, schema) if on else None
            for i, (schema, on) in enumerate(zip(self.record_schemas, self.schedules), 1)
        ]

    def handleInputRows(self, key, rows, timerValues):
        records = [(r["us"], r["input"], r["ord"], r[f"r{r['input']}"]) for slot in rows for r in slot["records"]]
        yield from self._fold(key, records, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._fold(key, [], timerValues)

    def _fold(self, key, records, timerValues):
        # Slots that end by the watermark are complete; a scheduled record waits for its slot like any other.
        slot = SLOT_SECONDS * 1_000_000
        limit = timerValues.getCurrentWatermarkInMs() * 1000 // slot * slot
        for number, waiting in enumerate(self.waiting, 1):
            if waiting is not None:
                due = [(k, v) for k, v in waiting.iterator() if k[0] < limit]
                for k, v in due:
                    waiting.removeKey(tuple(k))
                    records.append((k[0], number, k[1], dict(zip(self.names[number - 1], v)), True))
        if not records:
            return
        records.sort(key=_place)
        for state in self.states:
            state.begin()
        later: list = []
        i = 0
        while i < len(records):
            at, number = records[i][:2]
            end = i
            while end < len(records) and records[end][0] == at and records[end][1] == number:
                end += 1
            together = [(at, r[3]) for r in records[i:end]]
            i = end
            plan = Later(number, at, self.names[number - 1])
            for out in self.folds[number - 1](key[0], together, *self.states, plan):
                yield Row(**dict(zip(self.output_fields, out)))
            if plan.added or plan.cancelled:
                self._plan(plan, records, i, later, limit)
        for state in self.states:
            state.flush()
        self._keep(later, slot)

    def _plan(self, plan, records, i, later, limit) -> None:
        if self.waiting[plan.input - 1] is None:
            raise ValueError("pass schedules=True for a fold that schedules or cancels records")
        for test in plan.cancelled:
            later[:] = [r for r in later if r[1] != plan.input or not test(r[0], r[3])]
            records[i:] = [r for r in records[i:] if len(r) < 5 or r[1] != plan.input or not test(r[0], r[3])]
            stored = self.waiting[plan.input - 1]
            for k, v in list(stored.iterator()):
                if test(k[0], dict(zip(self.names[plan.input - 1], v))):
                    stored.removeKey(tuple(k))
        for record in plan.added:
            if record[0] < limit:
                # A fifth field tells scheduled records from input.
                insort(records, (*record, True), lo=i, key=_place)
            else:
                later.append(record)

    def _keep(self, later, slot) -> None:
        for record in later:
            stored = self.waiting[record[1] - 1]
            n = 0
            while stored.containsKey((record[0], record[2], n)):
                n += 1
            stored.updateValue((record[0], record[2], n), tuple(record[3].values()))
            self.handle.registerTimer((record[0] // slot + 1) * slot // 1000)

    def close(self) -> None:
        pass


def _place(record) -> tuple:
    return record[:3]


def _tagged(df: DataFrame, key: str, time: str, order: str, due: Column | None, number: int) -> DataFrame:
    """Records of an input in the columns that all inputs share: key, due time, and a typed row."""
    own = [c for c in df.columns if c != time]
    us = F.unix_micros(time)
    # A record cannot become due before it arrives.
    at = us if due is None else F.greatest(F.coalesce(due, us), us)
    rows = [F.struct(*own).alias(f"r{number}")]
    record = F.struct(at.alias("us"), F.lit(number).alias("input"), F.col(order).cast("bigint").alias("ord"), *rows)
    return df.select(F.col(key).alias("key"), F.timestamp_micros(at).alias("_due"), F.col(time).alias("_time"), record.alias("record"))


def _union(inputs: list[DataFrame], delay: str, moved: list[bool]) -> DataFrame:
    types = [df.schema["record"].dataType[f"r{i}"].dataType for i, df in enumerate(inputs, 1)]
    shaped = []
    for i, df in enumerate(inputs, 1):
        rows = [F.col(f"record.r{i}") if i == j else F.lit(None).cast(t).alias(f"r{j}") for j, t in enumerate(types, 1)]
        record = F.struct("record.us", "record.input", "record.ord", *rows)
        shaped.append(df.select("key", "_due", "_time", record.alias("record")))
    # Each input has a watermark of its own, and the lowest counts: records of one wait for the other to catch up.
    parts = [df.drop("_time").withWatermark("_due", delay) for df in shaped]
    # Due times run ahead of event times, so event times of inputs that move rows are watched too. The filter
    # names the time, which keeps it above the node that watches it.
    clocks = [df.select("key", F.col("_time").alias("_due"), "record").withWatermark("_due", delay) for df, on in zip(shaped, moved) if on]
    parts += [df.where(F.col("_due") < F.timestamp_micros(F.lit(-(1 << 62)))) for df in clocks]
    merged = parts[0]
    for other in parts[1:]:
        merged = merged.unionByName(other)
    return merged


def _run(inputs, delay, folds, values, items, output, dues, schedules):
    records = [df.schema["record"].dataType[f"r{i}"].dataType for i, df in enumerate(inputs, 1)]
    schemas = [", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.fields) for s in records]
    names = [s.fieldNames() for s in records]
    processor = Fold(folds, values, items, schemas, names, StructType.fromDDL(output).fieldNames(), schedules)
    slots = (
        _union(inputs, delay, [d is not None for d in dues])
        .groupBy("key", F.window("_due", f"{SLOT_SECONDS} seconds").alias("_slot"))
        .agg(F.collect_list("record").alias("records"))
        # The watermark needs no column here, and a slot may be beyond what Python's datetime holds.
        .select("key", "records")
    )
    return slots.groupBy("key").transformWithState(
        statefulProcessor=processor, outputStructType=StructType.fromDDL(output), outputMode="Append", timeMode="EventTime"
    )


def stateful_unary(
    df: DataFrame, key: str, time: str, order: str, fold: Callable, output: str,
    value: str = "v BIGINT", items: str = "v BIGINT", due: Column | None = None, delay: str = "0 seconds", schedules: bool = False,
) -> DataFrame:
    """fold(key, [(due_us, row)], state, later) -> output tuples; one call per due time of a key.

    `time` is a TIMESTAMP column; rows reach the fold as dicts of the other columns, with the values of their types. `value` and `items`
    are the state's schemas. `due` (microseconds) delays rows; explode the input first to deliver a row more than
    once. A fold that uses `later` says so with `schedules`.
    """
    inputs = [_tagged(df, key, time, order, due, 1)]
    return _run(inputs, delay, [fold], [value], [items], output, [due], [schedules])


def state_machine(
    df: DataFrame, key: str, time: str, order: str, fold: Callable[[Any, dict, tuple | None], tuple[bool, tuple, Iterable]],
    output: str, value: str, delay: str = "0 seconds",
) -> DataFrame:
    """fold(key, row, state) -> (remove, new_state, outputs) per record; state is None at first touch."""

    def step(key, due, state, later):
        current = state.get()
        for _, row in due:
            remove, current, outputs = fold(key, row, current)
            if remove:
                current = None
            yield from outputs
        state.set(current)

    return stateful_unary(df, key, time, order, step, output, value=value, delay=delay)


def stateful_binary(
    left: DataFrame, right: DataFrame, keys: tuple[str, str], times: tuple[str, str], orders: tuple[str, str],
    folds: tuple[Callable, Callable], output: str,
    values: tuple[str, str] = ("v BIGINT", "v BIGINT"), items: tuple[str, str] = ("v BIGINT", "v BIGINT"),
    dues: tuple[Column | None, Column | None] = (None, None), delay: str = "0 seconds", schedules: tuple[bool, bool] = (False, False),
) -> DataFrame:
    """Two inputs, both folds see both states: fold_i(key, due, state1, state2, later) -> outputs.

    At equal due times the first input folds first. Records wait until both inputs are past their due time.
    """
    inputs = [
        _tagged(df, k, t, o, d, n) for n, (df, k, t, o, d) in enumerate(zip((left, right), keys, times, orders, dues), 1)
    ]
    return _run(inputs, delay, list(folds), list(values), list(items), output, list(dues), list(schedules))
