"""Operator 1, substring dedup with suffix arrays: removes bytes of long strings that an earlier document has.

Shards of recurring text (see `passages`) get a suffix array by induced sorting; permuted common
prefixes cut it into classes of suffixes that share the length that matters, and the smallest doc_id of a
class decides for all of its places.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bidflow.llm.passages import NO_ID, Method, Repeats, Segments, Units, without_repeats
from bidflow.llm.shared import bytes_of, mixed, table
from bidflow.llm.suffix_array import permuted_common_prefixes, suffix_array

LENGTH = 50
#: Long enough that a phrase hardly recurs by chance, whatever the size of the corpus.
PHRASE = 24


def byte_units(rows: pa.Table) -> Units:
    rows = rows.set_column(rows.column_names.index("doc_id"), "doc_id", pa.compute.fill_null(rows.column("doc_id"), NO_ID))
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    data, bounds = bytes_of(rows.column("text").combine_chunks())
    return Units(np.array(rows.column("doc_id")), bounds, data, None, None, data)


def byte_phrases(data: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from each place on."""
    words = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data).tobytes(), strides=(1,))
    first, second, third = words[:-16], words[8:-8], words[16:]
    return mixed((first * np.uint64(0x9E3779B97F4A7C15) ^ second) * np.uint64(0xC2B2AE3D27D4EB4F) ^ third)


def repeated_bytes(segments: Segments) -> Repeats:
    """Stretches of windows that also occur in a document before the segment's own or in a second place.

    Equal windows have equal keys, so the windows of a segment that is alone under its key occur where the segment
    does and, at most, again inside it, which is the same document: its own place is the first and needs no array.
    """
    count = len(segments.bounds) - 1
    edge = np.flatnonzero(np.concatenate([[True], segments.key[1:] != segments.key[:-1], [True]]))
    alone = np.zeros(count, bool)
    alone[edge[:-1][np.diff(edge) == 1]] = True
    windows = np.diff(segments.bounds) - LENGTH + 1
    whole = np.flatnonzero(alone & segments.many)
    none = np.zeros(len(whole), np.int64)
    direct = Repeats(whole, none, windows[whole], segments.doc[whole], none)
    rest = np.flatnonzero(~alone)
    if not len(rest):
        return direct
    length = np.diff(segments.bounds)[rest]
    kept = np.repeat(~alone, np.diff(segments.bounds))
    found = repeated_in_array(
        Segments(
            segments.data[kept], np.concatenate([[0], np.cumsum(length)]), segments.key[rest], segments.doc[rest], segments.offset[rest],
            segments.many[rest],
        )
    )
    segment = np.concatenate([whole, rest[found.segment]])
    order = np.argsort(segment, kind="stable")
    return Repeats(segment[order], *(np.concatenate([getattr(direct, n), getattr(found, n)])[order] for n in ("start", "stop", "doc", "offset")))


def repeated_in_array(segments: Segments) -> Repeats:
    """`repeated_bytes` of segments by their suffix array."""
    count = len(segments.bounds) - 1
    length = np.diff(segments.bounds)
    # Symbol 1 ends a segment, 0 the whole.
    text = np.zeros(int(length.sum()) + count + 1, np.uint16)
    place = np.arange(len(segments.data)) + np.repeat(np.arange(count), length)
    text[:-1] = 1
    text[place] = segments.data.astype(np.uint16) + 2
    order = suffix_array(text, 258, ends=2)
    shared = permuted_common_prefixes(text, order, ends=2) >= LENGTH
    begin = segments.bounds[:-1] + np.arange(count)
    # Windows in the order of the array: only they can share the length, so classes are runs of it.
    windows = length - LENGTH + 1
    is_window = np.zeros(len(text), bool)
    at = np.repeat(begin, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    is_window[at] = True
    order = order[is_window[order]]
    heads = np.flatnonzero(~shared[order])
    owner = np.zeros(len(text), np.int32)
    owner[at] = np.repeat(np.arange(count, dtype=np.int32), windows)
    doc = segments.doc[owner[order]]
    size = np.diff(np.append(heads, len(order)))
    least = np.full(len(text), NO_ID, np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc, heads), size) if len(order) else 0
    twice = np.zeros(len(text), bool)
    twice[order] = np.repeat(size > 1, size)
    # Stretches of neighbouring windows with the same smallest document.
    of, least, twice = owner[at], least[at], twice[at] | segments.many[owner[at]]
    cut = np.ones(len(at), bool)
    cut[1:] = (of[1:] != of[:-1]) | (least[1:] != least[:-1]) | (twice[1:] != twice[:-1])
    first = np.flatnonzero(cut)
    stop = np.append(first[1:], len(at))
    keep = twice[first]
    first, stop = first[keep], stop[keep]
    base = np.cumsum(windows) - windows
    segment = of[first].astype(np.int64)
    return Repeats(segment, first - base[segment], stop - base[segment], least[first], np.zeros(len(first), np.int64))


def later_document(doc, offset, first_doc, first_offset):
    return doc > first_doc


METHOD = Method(LENGTH, PHRASE, byte_units, byte_phrases, repeated_bytes, False, later_document)


def substring_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), spans (start and end byte of removed runs).

    Texts are UTF-8 bytes, null ones empty. A byte goes if a string of 50 bytes that covers it also starts in
    a document with a smaller doc_id; documents without an id come last, and rows with equal ids do not
    affect each other. Texts below 50 bytes stay whole. Other columns are ignored. `with_text` False
    leaves kept and spans null.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def finish(units: Units, gone: np.ndarray) -> pa.Table:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        rows = []
        for doc, a, b in zip(units.docs.tolist(), units.bounds[:-1].tolist(), units.bounds[1:].tolist()):
            mask = gone[a:b]
            removed = int(mask.sum())
            left = units.data[a:b][~mask].tobytes() if removed else units.data[a:b].tobytes()
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))) if removed else edges[:0]
            spans = [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)] if with_text else None
            rows.append((None if doc == NO_ID else doc, b - a, removed, len(edge) // 2, hashlib.sha256(left).hexdigest(), left if with_text else None, spans))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(span)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = (
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, "
        "spans array<struct<start: long, end: long>>"
    )
    return without_repeats(docs, METHOD, finish, schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept", "spans")
