"""Fragments of the alignment of two tokenizations, and how they are put together.

Two tokenizations A and B of the same bytes are cut into groups where tokens of both end. A byte range of a
text owns the tokens that start in it. What it knows is a fragment: the groups it can close, and before and
after them open tokens whose groups reach beyond the range. Fragments of neighbouring ranges compose, and
composition is associative, so a text may be aligned in ranges that are put together in any order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

NONE = np.zeros(0, np.int64)


@dataclass
class Tokens:
    """Ids and byte lengths of consecutive tokens of A and of B."""

    a: np.ndarray = field(default_factory=lambda: NONE)
    a_len: np.ndarray = field(default_factory=lambda: NONE)
    b: np.ndarray = field(default_factory=lambda: NONE)
    b_len: np.ndarray = field(default_factory=lambda: NONE)

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*[np.concatenate([getattr(self, f), getattr(other, f)]) for f in ("a", "a_len", "b", "b_len")])

    def part(self, a: slice, b: slice) -> Tokens:
        return Tokens(self.a[a], self.a_len[a], self.b[b], self.b_len[b])


def expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ranges, each of a number of values from a start on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Digits:
    """Decimal forms of ids up to a largest one, for writing many at once."""

    def __init__(self, largest: int):
        ids = np.arange(largest + 1)
        self.width = len(str(largest))
        self.length = np.ones(len(ids), np.int64)
        for k in range(1, self.width):
            self.length += ids >= 10**k
        place = self.length[:, None] - 1 - np.arange(self.width)[None, :]
        self.forms = np.where(place >= 0, ids[:, None] // 10 ** np.maximum(place, 0) % 10 + 48, 0).astype(np.uint8)


@dataclass
class Runs:
    """The alignment of runs of tokens that start and end with groups.

    text holds the groups of all runs, `a1,a2|b1;a3|b2,b3`, those of run i from cuts[i] to cuts[i + 1]; link_a
    and link_b are the ids of tokens whose bytes overlap, those of run i from links[i] to links[i + 1].
    """

    groups: np.ndarray
    text: bytes
    cuts: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    links: np.ndarray


def align(tokens: Tokens, a_runs: np.ndarray, b_runs: np.ndarray, digits: Digits) -> Runs:
    """Aligns runs in one go; run i has the A tokens a_runs[i] to a_runs[i + 1], and B tokens likewise.

    The bytes of a run's A and B tokens are the same, so offsets can be counted through all runs.
    """
    a_end, b_end = np.cumsum(tokens.a_len), np.cumsum(tokens.b_len)
    a_start, b_start = a_end - tokens.a_len, b_end - tokens.b_len
    # A group ends where a token of each ends.
    a_last, b_last = np.isin(a_end, b_end, assume_unique=True), np.isin(b_end, a_end, assume_unique=True)
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    groups = np.diff(np.concatenate([[0], np.cumsum(a_last)])[a_runs])
    first = np.searchsorted(b_end, a_start, side="right")
    number = np.searchsorted(b_start, a_end, side="left") - first
    link_a, link_b = np.repeat(tokens.a, number), tokens.b[expanded(first, number)]
    links = np.concatenate([[0], np.cumsum(number)])[a_runs]
    # In the text the A tokens of a group stand before its B tokens.
    a_ends = np.flatnonzero(a_last) + 1
    b_begins = np.concatenate([[0], np.flatnonzero(b_last) + 1])
    at_a = np.arange(len(a_end)) + b_begins[a_group]
    at_b = np.arange(len(b_end)) + (a_ends[b_group] if len(b_end) else NONE)
    ids, mark = np.empty(len(a_end) + len(b_end), np.int64), np.empty(len(a_end) + len(b_end), np.uint8)
    ids[at_a], ids[at_b] = tokens.a, tokens.b
    mark[at_a], mark[at_b] = np.where(a_last, ord("|"), ord(",")), np.where(b_last, ord(";"), ord(","))
    size = digits.length[ids]
    wide = np.zeros((len(ids), digits.width + 1), np.uint8)
    wide[:, : digits.width] = digits.forms[ids]
    wide[np.arange(len(ids)), size] = mark
    ends = np.concatenate([[0], np.cumsum(size + 1)])
    flat = wide[np.arange(digits.width + 1)[None, :] <= size[:, None]]
    return Runs(groups, flat.tobytes(), ends[a_runs + b_runs], link_a, link_b, links)


@dataclass
class Fragment:
    """What a byte range of a text contributes. Without a cut all its tokens are open and stand in `before`."""

    cut: bool = False
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    #: Closed groups in order, each followed by a semicolon.
    text: bytes = b""
    #: Linked pairs of the closed groups as one number each, ascending, and how often they are linked.
    pairs: np.ndarray = field(default_factory=lambda: NONE)
    times: np.ndarray = field(default_factory=lambda: NONE)
    before: Tokens = field(default_factory=Tokens)
    after: Tokens = field(default_factory=Tokens)


def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(pairs, return_inverse=True)
    return found, np.bincount(where, weights=times, minlength=len(found)).astype(np.int64)


def closed(tokens: Tokens, digits: Digits, base: int) -> Fragment:
    """The fragment of tokens that start and end with groups; all of them are closed."""
    if not len(tokens.a):
        return Fragment(cut=True)
    runs = align(tokens, np.array([0, len(tokens.a)]), np.array([0, len(tokens.b)]), digits)
    pairs, times = np.unique(runs.link_a * base + runs.link_b, return_counts=True)
    return Fragment(True, 0, 0, int(runs.groups[0]), len(runs.link_a), runs.text, pairs, times)


def fragment(tokens: Tokens, a_start: int, b_start: int, digits: Digits, base: int) -> Fragment:
    """The fragment of tokens of a range; the first ones of A and B start at these places."""
    own = Fragment(n_a=len(tokens.a), n_b=len(tokens.b))
    a = a_start + np.cumsum(tokens.a_len) - tokens.a_len
    b = b_start + np.cumsum(tokens.b_len) - tokens.b_len
    _, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(in_a):
        own.before = tokens
        return own
    middle = closed(tokens.part(slice(in_a[0], in_a[-1]), slice(in_b[0], in_b[-1])), digits, base)
    middle.n_a, middle.n_b = own.n_a, own.n_b
    middle.before = tokens.part(slice(0, in_a[0]), slice(0, in_b[0]))
    middle.after = tokens.part(slice(in_a[-1], None), slice(in_b[-1], None))
    return middle


def compose(parts: list[Fragment], digits: Digits, base: int) -> Fragment:
    """The fragment of neighbouring ranges: open tokens between two cuts become closed groups."""
    out, texts, pairs, times = Fragment(), [], [], []
    for part in parts:
        out.n_a, out.n_b = out.n_a + part.n_a, out.n_b + part.n_b
        between = part.before
        if out.cut and part.cut:
            joint = closed(out.after + between, digits, base)
            for piece in (joint, part):
                out.n_groups, out.n_links = out.n_groups + piece.n_groups, out.n_links + piece.n_links
                texts.append(piece.text)
                pairs.append(piece.pairs)
                times.append(piece.times)
            out.after = part.after
        elif out.cut:
            out.after = out.after + between
        elif part.cut:
            out.before, out.after, out.cut = out.before + between, part.after, True
            out.n_groups, out.n_links = part.n_groups, part.n_links
            texts, pairs, times = [part.text], [part.pairs], [part.times]
        else:
            out.before = out.before + between
    out.text = b"".join(texts)
    if pairs:
        out.pairs, out.times = summed(np.concatenate(pairs), np.concatenate(times))
    return out


def whole(part: Fragment, digits: Digits, base: int) -> Fragment:
    """The alignment of a whole text from its fragment: its end closes what is open."""
    done = compose([part, Fragment(cut=True)], digits, base)
    done.text = done.text[:-1]
    return done
