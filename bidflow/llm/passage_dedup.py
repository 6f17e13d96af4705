"""Operator 4, passage dedup with Aho-Corasick automata: removes words of passages that occur earlier.

Shards of recurring text (see `passages`) confirm which stretches of windows recur together, compile
them into one automaton over word numbers, and run all of the shard's text through it to locate
every occurrence.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bidflow.llm.passages import NO_ID, Method, Repeats, Segments, Units, expand, without_repeats
from bidflow.llm.shared import bytes_of, mixed, prefix_sums, span_hash, table, word_spans

WORDS = 20
PHRASE = 8


def word_units(rows: pa.Table) -> Units:
    """Words of texts; `data` has each text's words joined by one space."""
    rows = rows.set_column(rows.column_names.index("doc_id"), "doc_id", pa.compute.fill_null(rows.column("doc_id"), NO_ID))
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts = rows.column("text").combine_chunks().cast(pa.binary()).to_pylist()
    joined = [b" ".join(t.split()) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in joined])])
    data = np.frombuffer(b"".join(joined), np.uint8)
    starts, ends, firsts = word_spans(data, bounds)
    return Units(np.array(rows.column("doc_id")), firsts, span_hash(prefix_sums(data), starts, ends), starts, ends, data)


def word_phrases(codes: np.ndarray) -> np.ndarray:
    sums = prefix_sums(codes)
    at = np.arange(len(codes) - PHRASE + 1)
    return span_hash(sums, at, at + PHRASE)


def stretches(window: np.ndarray, following: np.ndarray, before: np.ndarray, count: int) -> np.ndarray:
    """For each distinct window whether the one after it always follows it and is always preceded by it.

    window: number of the distinct window at each place; following and before: those of its neighbours, -1
    at the ends of segments. Such windows form stretches that occur only as a whole.
    """
    def only(values: np.ndarray) -> np.ndarray:
        low, high = np.full(count, 1 << 62, np.int64), np.full(count, -2, np.int64)
        np.minimum.at(low, window, values)
        np.maximum.at(high, window, values)
        return np.where((low == high) & (low >= 0), low, -1)

    after, prior = only(following), only(before)
    ok = after >= 0
    ok[ok] = prior[after[ok]] == np.flatnonzero(ok)
    return np.where(ok, after, -1)


def located(segments: Segments) -> Repeats:
    """Every occurrence of a recurring stretch of windows, with the first place of the stretch."""
    import ahocorasick

    starts, ends, firsts = word_spans(segments.data, segments.bounds)
    # Numbers of distinct words, which are the letters of the automaton.
    raw = segments.data.tobytes()
    numbers: dict[bytes, int] = {}
    letters = [numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist())]
    words = np.diff(firsts)
    windows = words - WORDS + 1
    owner = np.repeat(np.arange(len(words)), windows)
    within = expand(windows)
    at = firsts[owner] + within
    sums = prefix_sums(np.array(letters, np.uint64))
    distinct, head, window, count = np.unique(span_hash(sums, at, at + WORDS), return_index=True, return_inverse=True, return_counts=True)
    many = count > 1
    np.logical_or.at(many, window, segments.many[owner])
    inner = within + 1 < windows[owner]
    after = np.full(len(window), -1, np.int64)
    after[:-1] = np.where(inner[:-1], window[1:], -1)
    prior = np.full(len(window), -1, np.int64)
    prior[1:] = np.where(within[1:] > 0, window[:-1], -1)
    # Windows that recur, in stretches: at the head's place, up to where the chain of windows ends.
    chain = stretches(window, after, prior, len(distinct))
    chained = np.zeros(len(window), bool)
    chained[1:] = (prior[1:] >= 0) & (chain[window[:-1]] == window[1:]) & (many[window[:-1]] == many[window[1:]])
    begins = np.flatnonzero(~chained)
    stop = np.append(begins[1:], len(window))
    wanted = many[window[begins]] & (head[window[begins]] == begins)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    size = []
    for a, b in zip(begins[wanted].tolist(), stop[wanted].tolist()):
        automaton.add_word(tuple(letters[at[a] : at[b - 1] + WORDS]), len(size))
        size.append(b - a)
    none = np.zeros(0, np.int64)
    if not size:
        return Repeats(none, none, none, none, none)
    automaton.make_automaton()
    found = []
    for i, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
        found.extend((i, end, which) for end, which in automaton.iter(tuple(letters[a:b])))
    segment, end, which = np.array(found, np.int64).reshape(-1, 3).T
    length = np.array(size, np.int64)[which]
    start = end + 1 - WORDS + 1 - length
    doc, offset = segments.doc[segment], segments.offset[segment] + start
    order = np.lexsort((offset, doc, which))
    leads = order[np.concatenate([[True], which[order][1:] != which[order][:-1]])]
    first = np.empty(len(size), np.int64)
    first[which[leads]] = leads
    first = first[which]
    order = np.lexsort((start, segment))
    return Repeats(*(v[order] for v in (segment, start, start + length, doc[first], offset[first])))


def not_first(doc, offset, first_doc, first_offset):
    return (doc != first_doc) | (offset != first_offset)


METHOD = Method(WORDS, PHRASE, word_units, word_phrases, located, True, not_first)


def passage_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space).

    A word goes if a window of 20 words of its document that covers it also starts earlier: in a
    document with a smaller doc_id, or before in the same one. Documents without an id come last; rows
    that share doc_id and text are one document. Null texts have no words. Other columns are ignored.
    `with_text` False leaves kept null.
    """

    def finish(units: Units, gone: np.ndarray) -> pa.Table:
        rows = []
        for doc, a, b in zip(units.docs.tolist(), units.bounds[:-1].tolist(), units.bounds[1:].tolist()):
            low, high = (int(units.starts[a]), int(units.ends[b - 1])) if b > a else (0, 0)
            left, mask = units.data[low:high].tobytes(), gone[a:b]
            removed = int(mask.sum())
            if removed:
                left = b" ".join([w for w, m in zip(left.split(b" "), mask.tolist()) if not m])
            rows.append((None if doc == NO_ID else doc, b - a, removed, hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return without_repeats(docs, METHOD, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept")
