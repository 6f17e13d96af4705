"""Spelling variants against every pair of words, and the words themselves against a plain count."""

import collections
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from bidflow.llm import variants as v

CAPITALS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(docs, noise=31):
    seen = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(CAPITALS)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return dict(seen)


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def plain_variants(words, factor=10):
    near = collections.defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for word, n in words.items():
        best = min(near[word], key=lambda w: (-words[w], w), default=None)
        if best is not None and words[best] >= factor * n:
            form[word] = best
    out = []
    for word, n in words.items():
        root = word
        while root in form:
            root = form[root]
        out.append((word, n, form.get(word), words.get(form.get(word)), root, len(near[word])))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "n", "form", "form_n", "root", "n_near").collect())


def made_up(seed, letters, size=250):
    """Words near each other: few letters, repeated letters, edits at every place."""
    rng = random.Random(seed)
    words = {}
    while len(words) < size:
        word = "".join(rng.choices(letters, k=rng.randrange(4, 10)))
        for _ in range(4):
            words[word] = rng.choice([1, 2, 3, 10, 20, 30, 200, 3000])
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])
            if len(word) < 4:
                break
    return words


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abc"), (3, "abcdefgh"), (4, "aé×ÿß")])
def test_against_all_pairs(spark, seed, letters):
    words = made_up(seed, letters)
    given = spark.createDataFrame(list(words.items()), "word string, n long").withColumns({"key": F.lit(1), "up": F.lit("x")})
    assert rows(v.variants(given)) == plain_variants(words)
    assert rows(v.variants(given, 2)) == plain_variants(words, 2)


def test_each_pair_is_found_once(spark):
    words = made_up(5, "abc")
    pairs = [(r.a, r.b) for r in v.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long")).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs}) == sum(one_edit(a, b) for a, b in itertools.combinations(words, 2))


def test_forms_are_followed_to_the_last(spark):
    chain = {"abcdefg" + "x" * i: 2 * 10 ** (7 - i) for i in range(8)}
    assert {r[4] for r in rows(v.variants(spark.createDataFrame(list(chain.items()), "word string, n long")))} == {"abcdefg"}


def test_pivots_are_the_cheapest_disjoint_grams():
    rng = random.Random(0)
    for _ in range(300):
        places = sorted(rng.sample(range(9), rng.randrange(3, 6)))
        cost = {p: rng.randrange(20) for p in places}
        first, second = v.pivots(places, cost)
        assert second - first >= 2
        assert cost[first] + cost[second] == min(cost[a] + cost[b] for a, b in itertools.combinations(places, 2) if b - a >= 2)


def test_words_of_awkward_texts(spark):
    """Null and empty texts, null and repeated ids, very long texts and runs, letters outside the runs, extra columns."""
    texts = [None, "", " \n1234", "Straße STRASSE straße", "naïveté×÷ ÀÖß don't", "日本 abc日本def", "y" * 30_000, "Wordword " * 20_000, "a\x00b ſſſ"]
    docs = [(i, t) for i, t in enumerate(texts * 9)] + [(None, "nobody nobody"), (7, "again again"), (7, "again again")]
    given = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit(1), "run": F.lit("x"), "h": F.lit(3), "word": F.lit("w")})
    for noise in (31, 2, 0):
        found = {r.word: r.n for r in v.observed_words(given, noise).collect()}
        assert found == plain_words(docs, noise)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert v.observed_words(none).count() == 0
    assert rows(v.variants(v.observed_words(none))) == []


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    words = {w: n for w, n in plain_words(docs).items() if n >= 2 and len(w) >= 7}
    assert rows(v.op13_variants(spark, sf_dir)) == plain_variants(words)
