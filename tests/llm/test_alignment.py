"""Alignment of two tokenizers against a plain version on whole texts, and the laws of fragments."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import awkward

from bidflow.llm import alignment as al
from bidflow.llm import fragments as fr
from bidflow.llm import units

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


@pytest.fixture(scope="module")
def both():
    return units.Tokenizers(*units.load(A, B))


def plain(docs):
    """The contract read literally, with the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    table = units.Tokenizers(*units.load(A, B))
    texts, counts = [], collections.Counter()
    for doc, text in docs:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        a_bytes, b_bytes = [table.a_bytes[i] for i in a], [table.b_bytes[i] for i in b]
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            a, b, a_bytes, b_bytes = [], [], [], []
        a_end, b_end = np.cumsum([0, *map(len, a_bytes)]).tolist(), np.cumsum([0, *map(len, b_bytes)]).tolist()
        ends = sorted(set(a_end[1:]) & set(b_end[1:]))
        groups, i, j, links, first = [], 0, 0, collections.Counter(), 0
        for end in ends:
            ka, kb = a_end.index(end, i), b_end.index(end, j)
            groups.append(",".join(map(str, a[i:ka])) + "|" + ",".join(map(str, b[j:kb])))
            i, j = ka, kb
        for i, x in enumerate(a):
            while b_end[first + 1] <= a_end[i]:
                first += 1
            j = first
            while j < len(b) and b_end[j] < a_end[i + 1]:
                links[x, b[j]] += 1
                j += 1
        counts.update(links.keys())
        texts.append((doc, len(a), len(b), groups, links))
    top = collections.defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for doc, n_a, n_b, groups, links in texts:
        joined = ";".join(groups)
        best = sum(k for pair, k in links.items() if counts[pair] == top[pair[0]])
        total = sum(k * counts[pair] for pair, k in links.items())
        digest = hashlib.sha256(joined.encode()).hexdigest() if joined else ""
        out.append((doc, n_a, n_b, len(groups), sum(links.values()), best, total, digest, joined))
    return sorted(out, key=str)


def odd_texts():
    rng = random.Random(1)
    out = ["a  b", "\n\n  x", " lead", "trail  ", "a  b", "<|endoftext|> x", "<s> </s><0x41>", "x▁y", "▁", "  ", "it's  'll we'd", "\x85 x \x1c y",
           "a　 b 　c", "😀 😀😀 naïve", "日本語 " * 300, "no_space_" * 400, "y" * 3000, "a\r\n b", "é́ x"]
    letters = ["a", "b", " ", "  ", "\n", "é", "'s", "9", "!", " ", "　", "the", "日", ".", "<s>", " The", "zqx"]
    return out + ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(400)]


@pytest.mark.parametrize("sizes", [None, (200, 2), (37, 3)])
def test_against_plain(spark, sf_dir, sizes, monkeypatch):
    """Texts aligned whole, and cut into ranges anywhere, also inside letters and tokens, with trees of several levels."""
    if sizes:
        monkeypatch.setattr(al, "RANGE", sizes[0])
        monkeypatch.setattr(al, "FAN", sizes[1])
        monkeypatch.setattr(al, "BLOCK", 3000)
    docs = [(i, t) for i, (_, t) in enumerate(zip(range(10_000), odd_texts()))]
    docs += [(20_000 + r[0], r[1] if r[1] is None else r[1][:3000]) for r in awkward()]
    docs += [(None, "nobody's text"), (5, "twice the same"), (5, "twice the same")]
    docs += [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id") + 50_000, F.left("text", F.lit(4000))).limit(40).collect()]
    given = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit("r"), "block": F.lit(1), "pair": F.lit(2), "part": F.lit(3)})
    rows = sorted((tuple(r) for r in al.alignment(given.repartition(5), A, B, with_groups=True).select(*COLUMNS).collect()), key=str)
    assert rows == plain(docs)


def test_very_long_texts(spark):
    docs = [(1, "the long text " * 60_000), (2, "y" * 200_000), (3, "word\n" * 40_000), (4, "x▁" + "more " * 50_000)]
    rows = sorted((tuple(r) for r in al.alignment(spark.createDataFrame(docs, "doc_id long, text string"), A, B, True).select(*COLUMNS).collect()), key=str)
    assert rows == plain(docs)


def test_empty_table(spark):
    assert al.alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_units_keep_their_tokens(both, monkeypatch):
    """A small table that is full at once gives the same tokens as the libraries on whole texts."""
    monkeypatch.setattr(units, "TABLE_UNITS", 20)
    texts = odd_texts()
    for start in range(0, len(texts), 50):
        some = texts[start : start + 50]
        tokens, a_runs, b_runs, fine = both.tokens([units.units_of(t) for t in some])
        for i, text in enumerate(some):
            if fine[i]:
                assert tokens.a[a_runs[i] : a_runs[i + 1]].tolist() == both.a.encode(" " + text, add_special_tokens=False).ids
                assert tokens.b[b_runs[i] : b_runs[i + 1]].tolist() == both.b.encode(text)


def test_composition_is_associative():
    """Any tree over the fragments of consecutive ranges gives what the whole text gives."""
    rng = np.random.default_rng(4)
    digits = fr.Digits(99)
    for _ in range(200):
        length = int(rng.integers(1, 40))
        cut = [np.sort(rng.choice(np.arange(1, length), rng.integers(0, length), replace=False)) for _ in "ab"]
        sizes = [np.diff(np.concatenate([[0], c, [length]])) for c in cut]
        tokens = fr.Tokens(rng.integers(0, 99, len(sizes[0])), sizes[0], rng.integers(0, 99, len(sizes[1])), sizes[1])
        starts = [np.concatenate([[0], c]) for c in cut]
        bounds = np.unique(np.concatenate([[0, length], rng.integers(0, length, 5)]))
        parts = []
        for low, high in zip(bounds[:-1], bounds[1:]):
            inside = [np.searchsorted(s, [low, high]) for s in starts]
            first = [int(s[i[0]]) if i[0] < len(s) else length for s, i in zip(starts, inside)]
            parts.append(fr.fragment(tokens.part(slice(*inside[0]), slice(*inside[1])), *first, digits, 100))
        expected = fr.whole(fr.fragment(tokens, 0, 0, digits, 100), digits, 100)
        while len(parts) > 1:
            i = int(rng.integers(0, len(parts) - 1))
            parts[i : i + 2] = [fr.compose(parts[i : i + 2], digits, 100)]
        found = fr.whole(parts[0], digits, 100)
        assert (found.text, found.n_a, found.n_b, found.n_groups, found.n_links) == (expected.text, expected.n_a, expected.n_b, expected.n_groups, expected.n_links)
        assert found.pairs.tolist() == expected.pairs.tolist() and found.times.tolist() == expected.times.tolist()


def test_ranges_do_not_encode_a_stretch_twice():
    raw = b" " + b"word " * 50 + b"z" * 1000 + b" end of it" * 20
    found = al.ranges_of(raw, 64)
    assert [r[0] for r in found[1:]] == [r[1] for r in found[:-1]] and found[0][0] == 0 and found[-1][1] == len(raw)
    assert sum(stop - start for _, _, start, stop in found) < 2 * len(raw)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        units.load(public_tokenizers.path("word_bpe_49k.json"), B)
