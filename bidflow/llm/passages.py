"""Finds every passage that occurs more than once in a corpus, a part of the corpus at a time.

A window is a fixed number of consecutive units (bytes or words) of one text. Its key is the smallest
hash of the shorter phrases in it, so equal windows have equal keys wherever they stand, and
neighbouring windows mostly share theirs: a run of windows with one key is shipped as one segment.

1. Texts are dealt to groups by doc_id. Each group sends its distinct keys to buckets, which answer
   which keys occur elsewhere too. Most of the corpus takes no further part.
2. Groups send the distinct segments of recurring keys, with their first place, to the shard of the key.
   Whatever a key occurs in is in one shard, so a shard finds every repeat among its segments.
3. Shards answer with the first place of each repeated stretch; groups apply it to all equal segments.

A key that very many groups have would make a shard large; its windows are dealt by their own whole
content instead. Texts are shuffled once and the shuffle is read by all steps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.llm.shared import mixed, prefix_sums, span_hash, text_of, total_bytes

GROUP_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
#: Groups that may have a key before its windows are dealt by their content.
HOT_GROUPS = 256
BLOCK = 1 << 17
#: Documents without an id come after all others.
NO_ID = (1 << 63) - 1


@dataclass
class Units:
    """Texts of a group, in the order of doc_id, as units; `bounds` are unit offsets of texts."""

    docs: np.ndarray
    bounds: np.ndarray
    codes: np.ndarray
    #: Byte offsets of the start and end of each unit in `data`.
    starts: np.ndarray | None
    ends: np.ndarray | None
    data: np.ndarray

    def sums(self) -> np.ndarray:
        return prefix_sums(self.codes)

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_id of a unit and its offset in the text."""
        doc = np.searchsorted(self.bounds, unit, side="right") - 1
        return self.docs[doc], unit - self.bounds[doc]

    def bytes_between(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            return start, end
        return self.starts[start], self.ends[end - 1]


@dataclass(frozen=True)
class Method:
    window: int
    phrase: int
    #: Units of a table with columns doc_id and text.
    units: Callable[[pa.Table], Units]
    #: Hashes of the phrases that start at each unit of a stretch of codes.
    phrases: Callable[[np.ndarray], np.ndarray]
    #: Shard step: see `Segments` and `Repeats`.
    repeats: Callable[[Segments], Repeats]
    #: Whether a window also counts as recurring if it does so in one run.
    within: bool
    #: Whether an occurrence goes, given its doc_id and offset and those of the first one.
    goes: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Segments:
    """Distinct segments of a shard: their bytes one after another, and the first place of each."""

    data: np.ndarray
    bounds: np.ndarray
    key: np.ndarray
    doc: np.ndarray
    offset: np.ndarray
    #: Whether it occurs more than once.
    many: np.ndarray


@dataclass
class Repeats:
    """Stretches of windows of segments with the first place of their first window, by segment."""

    segment: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    doc: np.ndarray
    offset: np.ndarray


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def runs(units: Units, method: Method) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and key of every run of windows with one key."""
    n, window = len(units.codes), method.window
    first, keys = [], []
    last_key = np.zeros(0, np.uint64)
    room = np.zeros(n, bool)
    for a, b in zip(units.bounds[:-1].tolist(), units.bounds[1:].tolist()):
        room[a : max(a, b - window + 1)] = True
    starts_text = np.zeros(n + 1, bool)
    starts_text[units.bounds] = True
    for at in range(0, max(0, n - window + 1), BLOCK):
        stop = min(at + BLOCK, n - window + 1)
        key = sliding_min(method.phrases(units.codes[at : stop + window - 1]), window - method.phrase + 1)
        change = np.empty(len(key), bool)
        change[1:] = key[1:] != key[:-1]
        change[0] = not len(last_key) or last_key[0] != key[0]
        # Windows of different texts are apart, since no window starts in the last units of a text.
        before = room[at - 1 : stop - 1] if at else np.concatenate([[False], room[: stop - 1]])
        change |= ~before | starts_text[at:stop]
        change &= room[at:stop]
        where = np.flatnonzero(change)
        first.append(where + at)
        keys.append(key[where])
        last_key = key[-1:]
    if not first:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    # The smallest of many hashes is a small number; mixed again, keys spread over all buckets.
    start, key = np.concatenate(first), mixed(np.concatenate(keys) + np.uint64(1))
    ends = units.bounds[np.searchsorted(units.bounds, start, side="right")] - window + 1
    size = np.minimum(np.concatenate([start[1:], [n]]), ends) - start
    return start, size, key


def self_repeating(units: Units, method: Method, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Runs in which the phrase of the key stands twice, without which no two of their windows are equal."""
    if not len(start):
        return np.zeros(0, bool)
    phrases = mixed(method.phrases(units.codes) + np.uint64(1))
    reach = size + method.window - method.phrase
    equal = phrases[np.repeat(start, reach) + expand(reach)] == np.repeat(key, reach)
    return np.add.reduceat(equal.astype(np.int32), np.cumsum(reach) - reach) > 1


def by_content(units: Units, method: Method, sums: np.ndarray, start, size, key, hot: np.ndarray):
    """Runs with hot keys as single windows, whose key is their whole content."""
    is_hot = np.isin(key, hot)
    if not is_hot.any():
        return start, size, key, np.zeros(len(start), bool)
    n = size[is_hot]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    single = np.repeat(start[is_hot], n) + inner
    own = span_hash(sums, single, single + method.window)
    start = np.concatenate([start[~is_hot], single])
    size = np.concatenate([size[~is_hot], np.ones(len(single), np.int64)])
    marks = np.concatenate([np.zeros((~is_hot).sum(), bool), np.ones(len(single), bool)])
    return start, size, np.concatenate([key[~is_hot], own]), marks


def content(method: Method, sums: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mixed(span_hash(sums, start, start + size + method.window - 1) + size.astype(np.uint64))


def pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)


def unpack(raw: bytes, size: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, size * np.dtype(kind).itemsize, "zstd"), kind) if size else np.zeros(0, kind)


def expand(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


KEYS = "bucket long, group long, n long, keys binary, many binary"
FLAGS = "group long, bucket long, n long, flags binary"
SEGMENTS = (
    "bucket long, group long, n long, start binary, size binary, key binary, doc binary, offset binary, many binary, hot binary, "
    "bytes binary, length long, text binary"
)
ANSWERS = (
    "group long, n long, start binary, size binary, hot binary, "
    "m long, segment binary, low binary, high binary, doc binary, offset binary"
)


def arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def without_repeats(docs: DataFrame, method: Method, finish: Callable[[Units, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Applies `finish` to the units of each group of documents and the mask of units that go."""
    size = total_bytes(docs)
    groups = max(1, -(-size // GROUP_BYTES))
    bits = max(0, (-(-size // BUCKET_BYTES) - 1).bit_length())
    texts = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("group"), "doc_id", text_of().alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def bucket_of(key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)

    def short(key: np.ndarray) -> bytes:
        # Forty bits below those of the bucket tell keys apart well enough: a mistaken repeat only costs work.
        low = (key << np.uint64(bits)) >> np.uint64(24)
        return np.ascontiguousarray(low.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()

    def long(raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // 5, 8), np.uint8)
        out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
        return out.view("<u8").reshape(-1)

    def keys_of_group(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        units = method.units(table)
        start, size, key = runs(units, method)
        distinct, count = np.unique(key, return_counts=True)
        many = count > 1
        if method.within:
            many[np.searchsorted(distinct, key[self_repeating(units, method, start, size, key)])] = True
        owner = bucket_of(distinct)
        used = np.unique(owner)
        cuts = np.searchsorted(owner, np.append(used, 1 << 62))
        rows = [
            (int(b), group, int(y - x), short(distinct[x:y]), np.packbits(many[x:y]).tobytes())
            for b, x, y in zip(used, cuts[:-1], cuts[1:])
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow(KEYS))], schema=arrow(KEYS)) if rows else arrow(KEYS).empty_table()

    def recurring(table: pa.Table) -> pa.Table:
        parts = [long(x) for x in table.column("keys").to_pylist()]
        n = table.column("n").to_pylist()
        flag = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=k) for m, k in zip(table.column("many").to_pylist(), n)])
        key = np.concatenate(parts)
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
        count = np.diff(edge)
        flag[order] |= np.repeat(count > 1, count)
        flag[order] += np.repeat((count > HOT_GROUPS).astype(np.uint8), count)
        cuts = np.concatenate([[0], np.cumsum(n)])
        flags = [flag[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.Table.from_arrays([table.column("group"), table.column("bucket"), table.column("n"), pa.array(flags, pa.binary())], schema=arrow(FLAGS))

    def segments_of_group(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow(SEGMENTS).empty_table()
        units = method.units(left)
        start, size, key = runs(units, method)
        right = right.sort_by("bucket")
        flag = np.concatenate([np.frombuffer(x, np.uint8) for x in right.column("flags").to_pylist()])
        distinct = np.unique(key)
        sums = units.sums()
        chosen = np.isin(key, distinct[flag > 0])
        start, size, key, marks = by_content(units, method, sums, start[chosen], size[chosen], key[chosen], distinct[flag > 1])
        # The first of equal segments stands for all of the group.
        order = np.argsort(start, kind="stable")
        start, size, key, marks = start[order], size[order], key[order], marks[order]
        _, first, count = np.unique(content(method, sums, start, size), return_index=True, return_counts=True)
        owner = bucket_of(key[first])
        # In the order of the text, in which places compress well.
        order = np.lexsort((first, owner))
        first, count, owner = first[order], count[order], owner[order]
        doc, offset = units.place(start[first])
        low, high = units.bytes_between(start[first], start[first] + size[first] + method.window - 1)
        view = memoryview(units.data)
        used, cuts = np.unique(owner, return_index=True)
        rows = []
        for b, x, y in zip(used, cuts, [*cuts[1:], len(owner)]):
            take = first[x:y]
            text = b"".join([view[a:z] for a, z in zip(low[x:y].tolist(), high[x:y].tolist())])
            rows.append(
                (
                    int(b), left.column("group")[0].as_py(), int(y - x), pack(start[take].astype(np.int32)), pack(size[take].astype(np.int32)),
                    short(key[take]), pack(doc[x:y]), pack(offset[x:y].astype(np.int32)), pack(count[x:y] > 1), pack(marks[take]),
                    pack((high - low)[x:y].astype(np.int32)), len(text), pa.Codec("zstd", compression_level=6).compress(text, asbytes=True),
                )
            )
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow(SEGMENTS))], schema=arrow(SEGMENTS)) if rows else arrow(SEGMENTS).empty_table()

    def repeats_of_shard(table: pa.Table) -> pa.Table:
        n = np.array(table.column("n").to_pylist())

        def column(name: str, kind) -> np.ndarray:
            return np.concatenate([unpack(raw, k, kind) for raw, k in zip(table.column(name).to_pylist(), n.tolist())])

        length = column("bytes", np.int32).astype(np.int64)
        texts, same = [], []
        for raw, size, many, lengths in zip(*(table.column(c).to_pylist() for c in ("text", "length", "n", "bytes"))):
            text = np.frombuffer(pa.decompress(raw, size, "zstd"), np.uint8)
            lengths = unpack(lengths, many, np.int32).astype(np.int64)
            ends = np.cumsum(lengths)
            # The hash of each segment, from the bytes of one group at a time.
            same.append(mixed(span_hash(prefix_sums(text), ends - lengths, ends) + lengths.astype(np.uint64) * np.uint64(0x9E3779B1)))
            texts.append(text)
        data, same = np.concatenate(texts), np.concatenate(same)
        del texts
        key = np.concatenate([long(raw) for raw in table.column("key").to_pylist()])
        doc, offset = column("doc", np.int64), column("offset", np.int32).astype(np.int64)
        many = column("many", bool)
        bounds = np.concatenate([[0], np.cumsum(length)])
        # By key, so that a shard can be worked on in parts; the first place of equal segments first.
        order = np.lexsort((offset, doc, same, key))
        new = np.concatenate([[True], (same[order][1:] != same[order][:-1]) | (key[order][1:] != key[order][:-1])])
        head = order[new]
        owner = np.empty(len(order), np.int64)
        owner[order] = np.cumsum(new) - 1
        count = np.bincount(owner, minlength=len(head))
        seen = np.zeros(len(head), bool)
        np.logical_or.at(seen, owner, many)
        found = []
        at = 0
        sizes = np.cumsum(length[head])
        while at < len(head):
            # A part ends where a key ends.
            stop = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES, side="left")) + 1
            while stop < len(head) and key[head[stop]] == key[head[stop - 1]]:
                stop += 1
            stop = min(stop, len(head))
            part = head[at:stop]
            view = memoryview(data)
            text = b"".join([view[a:z] for a, z in zip(bounds[part].tolist(), bounds[part + 1].tolist())])
            made = method.repeats(
                Segments(
                    np.frombuffer(text, np.uint8), np.concatenate([[0], np.cumsum(length[part])]), key[part], doc[part], offset[part],
                    (count > 1)[at:stop] | seen[at:stop],
                )
            )
            made.segment = made.segment + at
            found.append(made)
            at = stop
        segment, low, high, fdoc, foffset = (np.concatenate([getattr(f, name) for f in found]) for name in ("segment", "start", "stop", "doc", "offset"))
        first = np.searchsorted(segment, np.arange(len(head) + 1))
        rows = []
        ends = np.cumsum(n)
        start, size, hot = column("start", np.int32), column("size", np.int32), column("hot", bool)
        for group, a, b in zip(table.column("group").to_pylist(), ends - n, ends):
            own = owner[a:b]
            stretches = (first[own + 1] - first[own]).astype(np.int64)
            some = np.flatnonzero(stretches)
            which = expand(stretches[some]) + np.repeat(first[own[some]], stretches[some])
            rows.append(
                (
                    group, len(some), pack(start[a:b][some]), pack(size[a:b][some]), pack(hot[a:b][some]), len(which),
                    pack(np.repeat(np.arange(len(some), dtype=np.int32), stretches[some])), pack(low[which].astype(np.int32)),
                    pack(high[which].astype(np.int32)), pack(fdoc[which]), pack(foffset[which].astype(np.int32)),
                )
            )
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow(ANSWERS))], schema=arrow(ANSWERS))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        units = method.units(left)
        gone = np.zeros(len(units.codes) + 1, np.int32)
        right = right.filter(pa.compute.greater(right.column("n"), 0)) if right.num_rows else right
        if right.num_rows:
            n, m = right.column("n").to_pylist(), right.column("m").to_pylist()

            def column(name: str, kind, sizes: list[int]) -> np.ndarray:
                return np.concatenate([unpack(raw, k, kind) for raw, k in zip(right.column(name).to_pylist(), sizes)])

            a_start, a_size, a_hot = column("start", np.int32, n).astype(np.int64), column("size", np.int32, n).astype(np.int64), column("hot", bool, n)
            segment = column("segment", np.int32, m).astype(np.int64) + np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), m)
            low, high = column("low", np.int32, m).astype(np.int64), column("high", np.int32, m).astype(np.int64)
            fdoc, foffset = column("doc", np.int64, m), column("offset", np.int32, m).astype(np.int64)
            start, size, key = runs(units, method)
            sums = units.sums()
            hot = np.unique(key[np.searchsorted(start, a_start[a_hot], side="right") - 1])
            start, size, key, _ = by_content(units, method, sums, start, size, key, hot)
            own = content(method, sums, start, size)
            order = np.argsort(own, kind="stable")
            asked = content(method, sums, a_start, a_size)
            left_at = np.searchsorted(own[order], asked, side="left")
            equal = np.searchsorted(own[order], asked, side="right") - left_at
            # Every stretch of a segment, at every run that equals the segment.
            times = equal[segment]
            at = start[order[np.repeat(left_at[segment], times) + expand(times)]]
            low, high, fdoc, foffset = (np.repeat(v, times) for v in (low, high, fdoc, foffset))
            doc, offset = units.place(at)
            going = method.goes(doc, offset + low, fdoc, foffset)
            np.add.at(gone, (at + low)[going], 1)
            np.add.at(gone, (at + high - 1 + method.window)[going], -1)
        return finish(units, np.cumsum(gone[:-1]) > 0)

    grouped = texts.repartition(parts, "group").groupBy("group")
    keys = grouped.applyInArrow(keys_of_group, KEYS)
    flags = keys.groupBy("bucket").applyInArrow(recurring, FLAGS)
    segments = grouped.cogroup(flags.groupBy("group")).applyInArrow(segments_of_group, SEGMENTS)
    answers = segments.groupBy("bucket").applyInArrow(repeats_of_shard, ANSWERS)
    return grouped.cogroup(answers.groupBy("group")).applyInArrow(apply, schema)
