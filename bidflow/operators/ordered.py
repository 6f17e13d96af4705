"""Running values over ordered rows per key, without putting a key's rows into one task.

Inputs larger than a slice are cut by (keys, order) at bounds found in one pass over those columns, so
a hot key covers many slices. Rows are shuffled once, by key and slice. Each slice computes its own
running values, and a small table carries the totals of earlier slices forward. Between two neighbouring
slices at most one key continues, so that table has fewer than two rows per slice, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bidflow.operators.sizing import slice_count


def _cols(names):
    return [F.col(n) for n in names]


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    rank: str | None = None,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Adds running columns per `keys` in `order` (ascending, must be a total order).

    rank       1-based row number
    sums       sum up to and including the row
    maxima     maximum up to and including the row
    latest     last non-null value up to and including the row
    previous   last non-null value before the row
    following  first non-null value after the row
    """
    sums, maxima = dict(sums or {}), maxima or {}
    latest, previous, following = latest or {}, previous or {}, following or {}
    if rank:
        sums[rank] = F.lit(1).cast("bigint")
    columns = df.columns
    args = (sums, maxima, latest, previous, following)

    # Inputs become columns first, so that both passes below read the same values.
    inputs = {}
    for group, values in zip(("sum", "max", "latest", "previous", "following"), args):
        for name, value in values.items():
            inputs[(group, name)] = f"_{group}_{name}"
    prepared = df.select(
        "*", *[dict(zip(("sum", "max", "latest", "previous", "following"), args))[g][n].alias(c)
               for (g, n), c in inputs.items()]
    )

    bounds = _bounds(df, keys, order, slices or slice_count(df))
    if not bounds:
        return _scan(prepared, keys, order, inputs).select(*columns, *[n for _, n in inputs])

    sliced, at_edge = _sliced(prepared, keys, order, bounds)
    carried = _carried(sliced.where(at_edge), keys, order, inputs)
    same = F.col("_slice") == F.col("_carry_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_carry_key_{k}"))
    local = _scan(sliced.join(F.broadcast(carried), same, "left"), [*keys, "_slice"], order, inputs)
    out = []
    for (group, name), _ in inputs.items():
        carry = F.col(f"_carry_{group}_{name}")
        here = F.col(name)
        if group == "sum":
            value = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
            value = F.when(here.isNotNull() | carry.isNotNull(), value)
        elif group == "max":
            value = F.greatest(here, carry)
        else:
            value = F.coalesce(here, carry)
        out.append(value.alias(name))
    return local.select(*columns, *out)


def _bounds(df, keys, order, slices):
    """The first (keys, order) of every slice but the first, as literals; ascending.

    One pass over the key and order columns only. The driver gets one row per slice.
    """
    if slices <= 1:
        return []
    names = [*keys, *order]
    first = (
        df.select(*names).repartitionByRange(slices, *_cols(names))
        .groupBy(F.spark_partition_id().alias("_part")).agg(F.min(F.struct(*names)).alias("low")).select("low.*")
    )
    first = first.orderBy(*names)
    plain = first.select(*[_to_plain(f).alias(f.name) for f in first.schema.fields])
    rows = [[_from_plain(F.lit(v), f) for v, f in zip(row, first.schema.fields)] for row in plain.collect()]
    return [F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows[1:]]


def _to_plain(field):
    """A column as something that comes back from Python exactly."""
    kind = field.dataType.simpleString()
    column = F.col(field.name)
    return F.unix_micros(column) if kind == "timestamp" else column.cast("string") if kind == "timestamp_ntz" else column


def _from_plain(value, field):
    kind = field.dataType.simpleString()
    return F.timestamp_micros(value.cast("bigint")) if kind == "timestamp" else value.cast(field.dataType)


def _sliced(df, keys, order, bounds):
    """Adds `_slice`, the number of bounds at or below a row, by binary search; and whether the
    row's key is also that of a bound next to its slice, without which no other slice has the key."""
    literals = F.array(*bounds)
    here = F.struct(*_cols([*keys, *order]))
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]

    def step(at, width):
        ahead = at + width
        return F.when((ahead <= len(bounds)) & (F.element_at(literals, ahead) <= here), ahead).otherwise(at)

    found = df.withColumn("_slice", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step))
    if not keys:
        return found, F.lit(True)

    def key_of(at):
        bound = F.element_at(literals, at)
        return F.struct(*[bound[k].alias(k) for k in keys])

    own = F.struct(*_cols(keys))
    low, high = F.greatest("_slice", F.lit(1)), F.least(F.col("_slice") + 1, F.lit(len(bounds)))
    return found, own.eqNullSafe(key_of(low)) | own.eqNullSafe(key_of(high))


def _scan(df, keys, order, inputs):
    forward = Window.partitionBy(*keys).orderBy(*order)
    to_here = forward.rowsBetween(Window.unboundedPreceding, 0)
    before = forward.rowsBetween(Window.unboundedPreceding, -1)
    # "After the row" is "before the row" in the opposite order: that frame grows row by row,
    # while a frame ending at unboundedFollowing is evaluated anew for every row.
    after = (
        Window.partitionBy(*keys)
        .orderBy(*[F.col(c).desc() for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    made = {}
    for (group, name), c in inputs.items():
        made[name] = {
            "sum": lambda c: F.sum(c).over(to_here),
            "max": lambda c: F.max(c).over(to_here),
            "latest": lambda c: F.last(c, ignorenulls=True).over(to_here),
            "previous": lambda c: F.last(c, ignorenulls=True).over(before),
            "following": lambda c: F.last(c, ignorenulls=True).over(after),
        }[group](c)
    return df.withColumns(made)


def _carried(sliced, keys, order, inputs):
    position = F.struct(*_cols(order))
    edges = []
    for (group, name), c in inputs.items():
        value = {
            "sum": lambda c: F.sum(c),
            "max": lambda c: F.max(c),
            "latest": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), position)),
            "previous": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), position)),
            "following": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), position)),
        }[group](c)
        edges.append(value.alias(c))
    per_slice = sliced.groupBy(*keys, "_slice").agg(*edges)

    # One row per slice the key touches: bounded by the slice count for any key.
    all_slices = Window.partitionBy(*keys)
    earlier = all_slices.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    later = all_slices.orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carries = []
    for (group, name), c in inputs.items():
        value = {
            "sum": lambda c: F.sum(c).over(earlier),
            "max": lambda c: F.max(c).over(earlier),
            "latest": lambda c: F.last(c, ignorenulls=True).over(earlier),
            "previous": lambda c: F.last(c, ignorenulls=True).over(earlier),
            "following": lambda c: F.last(c, ignorenulls=True).over(later),
        }[group](c)
        carries.append(value.alias(f"_carry_{group}_{name}"))
    return (
        per_slice.withColumn("_touched", F.count(F.lit(1)).over(all_slices))
        .where("_touched > 1")
        .select(*[F.col(k).alias(f"_carry_key_{k}") for k in keys], F.col("_slice").alias("_carry_slice"), *carries)
    )


def last_n_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    n: int,
    sums: dict[str, Column],
    *,
    block: int = 100_000,
    slices: int | None = None,
) -> DataFrame:
    """Adds sums over the last `n` rows per key (the row included).

    Inputs larger than a slice: rows are numbered per key, cut into blocks of `block` rows (n at
    least), and the last n - 1 rows of a block are repeated at the head of the next one. Groups then
    have a fixed size.
    """
    columns = df.columns
    slices, block = slices or slice_count(df), max(block, n)
    if slices == 1:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
        return df.withColumns({name: F.sum(value).over(frame) for name, value in sums.items()})

    ranked = running(df, keys, order, rank="_rank", slices=slices)
    number = F.expr(f"(_rank - 1) div {block}")
    is_tail = (F.col("_rank") - 1) % block > block - n
    homes = F.when(is_tail, F.array(number, number + 1)).otherwise(F.array(number))
    blocks = ranked.withColumn("_home", number).withColumn("_block", F.explode(homes))
    frame = Window.partitionBy(*keys, "_block").orderBy("_rank").rowsBetween(1 - n, 0)
    return (
        blocks.withColumns({name: F.sum(value).over(frame) for name, value in sums.items()})
        .where("_block = _home")
        .select(*columns, *sums)
    )
