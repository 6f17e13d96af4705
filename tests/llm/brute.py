"""Plain versions of the corpus operators, on lists of (doc_id, text)."""

from __future__ import annotations

import collections
import hashlib
import itertools


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def last(doc):
    return (doc is None, doc or 0)


def substring_dedup(docs, length=50):
    first = {}
    for doc, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window not in first or last(doc) < last(first[window]):
                first[window] = doc
    out = []
    for doc, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if last(first[raw[i : i + length]]) < last(doc):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g))))
    return out


def passage_dedup(docs, size=20):
    first = {}
    for doc, text in sorted(docs, key=lambda d: (last(d[0]), d[1] or "")):
        words = (text or "").encode().split()
        for i in range(len(words) - size + 1):
            first.setdefault(tuple(words[i : i + size]), (doc, i))
    out = []
    for doc, text in docs:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            if first[tuple(words[i : i + size])] != (doc, i):
                gone[i : i + size] = [True] * size
        out.append((doc, len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone) if not g))))
    return out


def shingles(text, lower=False):
    raw = (text or "").encode()
    words = (bytes(c + 32 if 65 <= c <= 90 else c for c in raw) if lower else raw).split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_dedup(docs, percent=85):
    """doc_id -> (number of shingles, component), for distinct ids that are not null."""
    sets = {doc: shingles(text, True) for doc, text in docs}
    holders = collections.defaultdict(list)
    for doc, own in sets.items():
        for shingle in own:
            holders[shingle].append(doc)
    shared = collections.Counter()
    for ids in holders.values():
        shared.update(itertools.combinations(sorted(ids), 2))
    up = {doc: doc for doc in sets}

    def top(doc):
        while up[doc] != doc:
            doc = up[doc]
        return doc

    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {doc: (len(own), top(doc)) for doc, own in sets.items()}


def resemblance(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0
