"""What several operators use: tables, batches of bounded size, word shingles, partition counts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the bytes of one column in a piece stay near a limit (one row at least)."""
    for batch in batches:
        sizes = np.diff(offsets_of(batch.column(batch.schema.get_field_index(column))))
        ends = np.cumsum(sizes)
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(ends, done + limit, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])
    give_back()


def give_back() -> None:
    """Returns unused memory to the system at the end of a task, since Python workers serve many tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array without nulls, and where each value starts and ends in them."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = offsets_of(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values, so that equal remainders or prefixes mean nothing."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Polynomials are taken modulo this prime. Modulo a power of two, different long texts of two letters have one
#: hash whatever the base is.
PRIME = (1 << 61) - 1
BASE = 0x9E3779B97F4A7C15 % PRIME
#: Powers kept for good; longer data is hashed in steps of so many values, which bounds the table and what a step needs.
STEP = 1 << 18
_POWERS: dict[str, np.ndarray] = {}

_P, _LOW, _29, _32, _61 = np.uint64(PRIME), np.uint64(0xFFFFFFFF), np.uint64(29), np.uint64(32), np.uint64(61)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high * 2**32 + low modulo the prime."""
    return _reduced((high >> _29) + ((high & np.uint64((1 << 29) - 1)) << _32) + (low & _P) + (low >> _61))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of values below it."""
    a1, a0, b1, b0 = a >> _32, a & _LOW, b >> _32, b & _LOW
    # 2**64 is 8 modulo the prime.
    return _reduced(((a1 * b1) << np.uint64(3)) + _joined(a1 * b0 + a0 * b1, a0 * b0))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to STEP of them, kept for the next call."""
    n = min(n, STEP)
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = min(STEP, 1 << max(16, (n - 1).bit_length()))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, PRIME))):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, _times(out, np.uint64(pow(base, len(out), PRIME)))])
            _POWERS[name] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which `span_hash` takes the hash of any run of values in constant time."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP]
        own = up[: len(part)]
        if part.dtype.itemsize == 1:
            values = part.astype(np.uint64) + np.uint64(1)
            high, low = values * (own >> _32), values * (own & _LOW)
        else:
            terms = _times(_reduced(_reduced(part.astype(np.uint64)) + np.uint64(1)), own)
            high, low = terms >> _32, terms & _LOW
        sums = _joined(np.cumsum(high), np.cumsum(low))
        if at:
            sums = _reduced(_times(sums, np.uint64(pow(BASE, at, PRIME))) + out[at])
        out[at + 1 : at + 1 + len(part)] = sums
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    starts = np.asarray(starts)
    out = _times(_reduced(sums[ends] + (_P - sums[starts])), down[starts % STEP] if len(sums) > STEP else down[starts])
    if len(sums) > STEP:
        steps = np.array([pow(BASE, -step * STEP, PRIME) for step in range(-(-len(sums) // STEP))], np.uint64)
        out = _times(out, steps[starts // STEP])
    return mixed(out)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words [^\\x20\\x09-\\x0D]+ of concatenated texts, and the index of the first word of each text."""
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = bounds[:-1][(bounds[:-1] < len(data)) & (np.diff(bounds) > 0)]
    first[cut] = solid[cut]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    end = bounds[1:][np.diff(bounds) > 0] - 1
    last[end] = solid[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def shingle_hashes(
    data: np.ndarray, bounds: np.ndarray, width: int = 5
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of concatenated texts, text by text, the index of the first one of
    each text, and each text's number of words. A text with fewer words has one shingle, its whole
    sequence; one without words has none."""
    starts, ends, firsts = word_spans(data, bounds)
    words = np.diff(firsts)
    # A word's hash covers its bytes only, so the kind and length of white space does not matter.
    codes = span_hash(prefix_sums(data), starts, ends)
    sums = prefix_sums(codes)
    count = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    where = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=where[1:])
    within = np.arange(where[-1]) - np.repeat(where[:-1], count)
    begin = np.repeat(firsts[:-1], count) + within
    return span_hash(sums, begin, begin + np.repeat(np.minimum(words, width), count)), where, words


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column; one row reaches the driver."""
    return docs.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0


#: A group with more than this share of the rows is joined by broadcast; there are fewer than 1 / share of them.
HOT_SHARE = 0.001


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of rows with their groups (one row per key, with its number of rows), safe for hot keys.

    A join on the key would send a large group's rows to one task. The groups above a share of the
    rows are few by arithmetic and are joined where their rows are; no other group is large against a task.
    """
    hot = F.col(count) > max(1, int(total * HOT_SHARE))
    marked = rows.join(F.broadcast(groups.filter(hot)), key, "left")
    rest = marked.filter(F.col(count).isNull()).select(rows.columns).join(groups.filter(~hot), key)
    found = marked.filter(F.col(count).isNotNull())
    return found.unionByName(rest.select(found.columns))
