"""Suffix arrays by induced sorting, and permuted common prefixes, on arrays of small integers.

Suffixes are classified, the substrings between leftmost-smaller suffixes are sorted by inducing, named,
and the string of their names is sorted by recursion; all suffixes are then induced from that order, one
bucket at a time. Names form an alphabet as large as their string, so a level below the first ranks pairs of
names, which doubles what a name stands for, until all names differ.
"""

from __future__ import annotations

import numpy as np


def classes(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last symbol must be smaller than all others."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = step[np.minimum(following, n - 2)] > 0
    return small


def ranked(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names; its last name is smaller than all others."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, np.int64)

    def settle(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Ranks the suffixes at these places, sorted by keys; returns the places whose keys are shared."""
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[order[places]] = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        alone = new & np.append(new[1:], True)
        return places[~alone]

    def deeper(places: np.ndarray, span: int) -> None:
        if not len(places):
            return
        some = order[places]
        keys = rank[some] * (n + 1) + rank[np.minimum(some + span, n - 1)]
        again = np.argsort(keys)
        order[places] = some[again]
        deeper(settle(places, keys[again]), 2 * span)

    deeper(settle(np.arange(n), names[order]), 1)
    return order


def by_symbol(positions: np.ndarray, text: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Positions by their symbol, in the given order within each."""
    if not len(positions):
        return []
    symbol = text[positions]
    order = np.argsort(symbol, kind="stable")
    symbol = symbol[order]
    cuts = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    return [(int(symbol[a]), p) for a, p in zip(cuts, np.split(positions[order], cuts[1:]))]


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


def within(first: np.ndarray, text: np.ndarray, symbol: int) -> np.ndarray:
    """Suffixes that a bucket induces in itself: runs of its symbol, nearest first."""
    parts, last = [first], first
    while len(last):
        last = last[last > 0] - 1
        last = last[text[last] == symbol]
        parts.append(last)
    return joined(parts)


def induce(text: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that follows from sorted leftmost-smaller suffixes."""
    seed = dict(by_symbol(seeds, text))
    none = np.zeros(0, np.int32)
    waiting: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    large = [none] * symbols
    for symbol in range(symbols):
        own = large[symbol] = within(joined(waiting[symbol]), text, symbol)
        source = joined([own, seed.get(symbol, none)])
        before = source[source > 0] - 1
        for target, part in by_symbol(before[text[before] > symbol], text):
            waiting[target].append(part)
    waiting = [[] for _ in range(symbols)]
    out: list[np.ndarray] = []
    for symbol in range(symbols - 1, -1, -1):
        # From the end of the bucket to its start.
        own = within(joined(waiting[symbol]), text, symbol)
        source = joined([own, large[symbol][::-1]])
        before = source[source > 0] - 1
        for target, part in by_symbol(before[text[before] < symbol], text):
            waiting[target].append(part)
        out.append(source)
    # The end of the text precedes nothing, so nothing induces it.
    out.append(np.array([len(text) - 1], np.int32))
    return np.concatenate(out)[::-1]


def suffix_array(text: np.ndarray, symbols: int, ends: int = 1) -> np.ndarray:
    """Starts of all suffixes in order. Symbols are below `symbols`; the last is 0 and occurs once.

    Symbols below `ends` mark ends of parts: no two of them count as equal, so nothing is compared beyond
    them. They must not stand at the start nor next to each other.
    """
    n = len(text)
    small = classes(text)
    edge = np.zeros(n, bool)
    edge[1:] = small[1:] & ~small[:-1]
    marks = np.flatnonzero(edge).astype(np.int32)
    if len(marks) < 2:
        return induce(text, marks, symbols)
    order = induce(text, marks, symbols)
    order = order[edge[order]]
    # Equal neighbours get one name: same length, same symbols.
    where = np.empty(n, np.int32)
    where[marks] = np.arange(len(marks))
    length = np.append(np.diff(marks), 1)[where[order]]
    differs = np.ones(len(order), bool)
    open_ = np.flatnonzero((length[1:] == length[:-1]) & (text[order[1:]] >= ends)) + 1
    differs[open_] = False
    step = 0
    while len(open_):
        a, b = order[open_] + step, order[open_ - 1] + step
        same = text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)]
        differs[open_[~same]] = True
        open_ = open_[same & (step < length[open_])]
        step += 1
    names = np.empty(len(marks), np.int64)
    names[where[order]] = np.cumsum(differs) - 1
    if not differs.all():
        order = marks[ranked(names)]
    return induce(text, order, symbols)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, ends: int = 1) -> np.ndarray:
    """For each suffix, in the order of the text, the length it shares with the one before it in `order`.

    Only suffixes whose left neighbours differ are compared; for the others the length is one less than
    that of the suffix to the left. Marks of ends (see `suffix_array`) differ from each other, but lengths may
    reach beyond them.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    own = np.ones(n, bool)
    own[1:] = (before[1:] < 1) | (text[:-1] < ends) | (text[:-1] != text[before[1:] - 1])
    at = np.flatnonzero(own & (before >= 0))
    length = np.zeros(n, np.int64)
    wide = np.zeros(n + 8, np.uint16)
    wide[:n] = text
    words = np.ndarray(n + 4, "<u8", wide.tobytes(), strides=(2,))
    open_, step = at, 0
    while len(open_):
        # Four symbols at a time; the end of the text stops every comparison.
        a, b = np.minimum(open_ + step, n), np.minimum(before[open_] + step, n)
        off = words[a] ^ words[b]
        same = off == 0
        ends = open_[~same]
        bit = off[~same]
        equal = (bit & np.uint64(0xFFFF) == 0).astype(np.int64)
        equal += (bit & np.uint64(0xFFFFFFFF) == 0)
        equal += (bit & np.uint64(0xFFFFFFFFFFFF) == 0)
        length[ends] = step + equal
        open_ = open_[same]
        step += 4
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return np.where(own, length, np.maximum(length[last] - (np.arange(n) - last), 0))
