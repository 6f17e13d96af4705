"""Every corpus operator against a plain version, also on awkward rows: nulls, empty and very long texts,
ties, repeated rows, other columns with clashing names, and empty tables."""

import random

import brute
import public_tokenizers
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from bidflow.llm import (
    components,
    exact_dedup,
    fingerprints,
    language,
    mixing,
    near_dedup,
    passage_dedup,
    passages,
    pieces,
    substring_dedup,
    token_counts,
    warc,
)
from bidflow.llm.registry import ORACLE, QUERIES
from bidflow.llm.suffix_array import permuted_common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="session")
def rows(docs):
    return [tuple(r) for r in docs.collect()]


def awkward():
    """Texts made of few words, so that they share much, with all the cases named above."""
    random.seed(5)
    words = ["ab", "a", "b", "ba", "Über", "x", "<|endoftext|>", "don't", "▁", "日本"]
    base = [" ".join(random.choices(words, k=k)) for k in (3, 30, 40, 200, 25)]
    texts = [None, "", " \t\n", "a", "a  b", "ab " * 400, "ab " * 401, "y" * 30_000, "z " * 20_000, "a\x00b", "ſ İ ΑΣ \x85 x"]
    for _ in range(60):
        part = random.sample(base, 2)
        texts.append(random.choice([" ", "\n\n", "  "]).join(p[random.randrange(4) : len(p) - random.randrange(4)] for p in part))
    out = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward rows with two columns whose names operators use themselves."""
    return spark.createDataFrame(awkward(), SCHEMA).withColumns({"score": F.lit("own"), "group": F.lit(1), "path": F.lit("p")}).repartition(3)


@pytest.fixture(scope="session")
def repeated(spark):
    """Rows without a doc_id, and rows that occur twice."""
    text = " ".join(f"w{i}" for i in range(60))
    return spark.createDataFrame([(7, text), (7, text), (None, text), (3, "w1 w2"), (None, None), (None, "other")], "doc_id long, text string")


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(name, spark, sf_dir):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_has_a_row_per_document(name, spark, sf_dir, rows):
    ids = [r.doc_id for r in QUERIES[name](spark, sf_dir).select("doc_id").collect()]
    assert sorted(ids) == sorted(d for d, _ in rows)


# -- repeats -------------------------------------------------------------------------------------


def test_suffix_array():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        text = np.append(rng.integers(1, rng.integers(2, 5), rng.integers(1, 70)), 0).astype(np.uint16)
        plain = text.tolist()
        order = suffix_array(text, 257)
        assert order.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        shared = permuted_common_prefixes(text, order)
        for a, b in zip(order[1:].tolist(), order[:-1].tolist()):
            n = 0
            while plain[a + n : a + n + 1] == plain[b + n : b + n + 1] != []:
                n += 1
            assert shared[a] == n


SUBSTRING = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
PASSAGE = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("scale", [None, (1500, 3000, 2)])
def test_repeats(docs, rows, odd, repeated, scale, monkeypatch):
    """With one group, and with many groups and shards and keys that count as hot."""
    if scale:
        for name, value in zip(("GROUP_BYTES", "BUCKET_BYTES", "HOT_GROUPS"), scale):
            monkeypatch.setattr(passages, name, value)
    some = [odd, repeated] if scale else [docs, odd, repeated]
    for df in some:
        plain = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = found(substring_dedup.substring_dedup(df, with_text=False), *SUBSTRING)
        assert got == sorted(brute.substring_dedup(plain), key=str)
        got = found(passage_dedup.passage_dedup(df, with_text=False), *PASSAGE)
        assert got == sorted(brute.passage_dedup(plain), key=str)


@pytest.mark.parametrize("scale", [None, (700, 900, 2)])
def test_repeats_that_stand_alone_under_their_key(spark, scale, monkeypatch):
    """Periodic texts, whole copies, and copies that share only a part, in one corpus."""
    if scale:
        for name, value in zip(("GROUP_BYTES", "BUCKET_BYTES", "HOT_GROUPS"), scale):
            monkeypatch.setattr(passages, name, value)
    random.seed(5)
    passage = "".join(random.choice("abcdefgh ") for _ in range(400))
    plain = [(1, "ab" * 90), (2, passage), (3, "ab" * 60 + passage[:120]), (4, passage), (5, "x" * 300), (6, passage[50:260] + "y" * 60)]
    plain += [(7, "x" * 80 + passage[200:]), (8, "z" * 200), (9, "z" * 200), (10, "q" * 49)]
    got = found(substring_dedup.substring_dedup(spark.createDataFrame(plain, "doc_id long, text string"), with_text=False), *SUBSTRING)
    assert got == sorted(brute.substring_dedup(plain), key=str)


def test_kept_texts_and_spans(spark):
    text = "0123456789" * 6
    df = spark.createDataFrame([(1, text), (2, "é" + text + "tail")], "doc_id long, text string")
    row = substring_dedup.substring_dedup(df).filter("doc_id = 2").first()
    assert bytes(row.kept).decode() == "étail" and [tuple(s) for s in row.spans] == [(2, 62)]
    words = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, words), (2, f"a\n{words}  b")], "doc_id long, text string")
    assert found(passage_dedup.passage_dedup(df), "doc_id", "kept") == [(1, words), (2, "a b")]


# -- language ------------------------------------------------------------------------------------


def test_language(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op2_language"](spark, sf_dir).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows_and_mixtures(spark, sf_dir, odd):
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, model = language.train(labelled)
    got = {r.doc_id: r for r in language.identify(odd, langs, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[0].score == 0 and got[1].path == "p"
    by = {r.lang: r.text for r in labelled.filter("length(text) > 2000").collect()}
    two = spark.createDataFrame([(1, by["en"][:2000] + " " + by["fr"][:2000])], "doc_id long, text string")
    shares = language.identify(two, langs, model).first().shares
    assert set(shares) == {"en", "fr"} and min(shares.values()) > 0.3
    none, empty = language.train(labelled.limit(0))
    assert none == [] and language.identify(two, none, empty).first().lang_pred == "und"


def test_as_many_languages_as_the_text_has():
    """Six of eight languages with trigrams of their own, in known shares."""
    import numpy as np

    model = np.full((8, 80), 0.001)
    for k in range(8):
        model[k, 10 * k : 10 * k + 10] = 1
    model /= model.sum(axis=1, keepdims=True)
    want = np.array([0.3, 0.2, 0.15, 0.15, 0.1, 0.1, 0, 0])
    shares, _ = language.infer((1000 * want @ model)[None, :].astype(np.float32), model.astype(np.float32))
    assert np.flatnonzero(shares[0]).tolist() == list(range(6)) and abs(shares[0] - want).max() < 0.01


# -- tokens --------------------------------------------------------------------------------------


def test_sentencepiece(docs, odd, repeated):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (docs, odd, repeated):
        want = []
        for doc, text in df.select("doc_id", "text").collect():
            ids = library.encode(text or "") + [library.eos_id()]
            want.append((doc, len(ids), ids, brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids))))
        got = found(pieces.encode(df, path), "doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")
        assert got == sorted(want, key=str)


def test_a_full_chunk_table_changes_nothing(odd, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    want = found(pieces.encode(odd, path), "doc_id", "ids_sha256", "decoded_sha256")
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 3)
    assert found(pieces.encode(odd, path), "doc_id", "ids_sha256", "decoded_sha256") == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts(docs, odd, repeated, name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(name))
    for df in (docs, odd, repeated):
        want = []
        for doc, text in df.select("doc_id", "text").collect():
            n = len(library.encode(text or "", add_special_tokens=False).ids)
            want.append((doc, len((text or "").encode()), n, n > 2048))
        got = found(token_counts.token_counts(df, public_tokenizers.path(name)), "doc_id", "n_bytes", "n_tokens", "over_limit")
        assert got == sorted(want, key=str)


# -- exact dedup ---------------------------------------------------------------------------------


def test_index_keeps_what_it_has_seen(spark, odd, repeated):
    index = exact_dedup.DigestIndex(spark, "test_digest_index", buckets=2)
    batch = "doc_id long, text string"
    first = found(index.add(spark.createDataFrame([(5, "a b"), (4, "a \t b"), (6, None), (2, "")], batch)), "doc_id", "keep_id", "group_size", "kept")
    assert first == [(2, 2, 2, True), (4, 4, 2, True), (5, 4, 2, False), (6, 2, 2, False)]
    again = found(index.add(spark.createDataFrame([(1, "a b"), (9, "new"), (None, "new"), (None, "own")], batch)), "doc_id", "keep_id", "kept")
    assert again == [(1, 4, False), (9, 9, True), (None, 9, False), (None, None, True)]
    assert index.rows().count() == 4
    assert index.add(odd.limit(0)).count() == 0
    assert found(exact_dedup.exact_dedup(repeated), "doc_id", "keep_id", "kept") == [
        (3, 3, True), (7, 7, True), (7, 7, True), (None, 7, False), (None, None, True), (None, None, True),
    ]


# -- archives ------------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    same = "h" * 200
    pages = spark.createDataFrame(
        [
            (1, "http://A.b.com/x?y", None), (2, None, same), (3, "https://u@b.com:80/", same), (3, "https://u@b.com:80/", same),
            (None, "plain\ntext é", same), (0, "http://a.b.com/x?y", "ü\r\n\r\n" * 50), (9, "", "x"), (8, "http://a.b.com/", "x"),
        ],
        "page_id long, url string, html string",
    ).withColumn("digest", F.lit("own"))
    folder = str(tmp_path)
    index = warc.write(pages, folder)
    got = found(warc.read(index, folder, with_payload=True), "page_id", "payload_bytes", "record_type", "refers_to", "payload")
    assert got == sorted(
        [
            (1, 0, "response", None, ""), (2, 200, "response", None, same), (3, 200, "revisit", 2, None), (3, 200, "revisit", 2, None),
            (None, 200, "revisit", 2, None), (0, 300, "response", None, "ü\r\n\r\n" * 50), (9, 1, "response", None, "x"), (8, 1, "response", None, "x"),
        ],
        key=str,
    )
    assert found(warc.read(index, folder, keys=["com,b,a)/x?y", "com,nowhere)/"]), "page_id") == [(0,), (1,)]
    assert found(warc.read(index, folder, keys=["plain\ntext é"]), "page_id") == [(None,)]
    assert warc.read(index, folder, keys=[]).count() == 0
    other = str(tmp_path / "none")
    assert warc.read(warc.write(pages.limit(0), other), other).count() == 0


# -- near dedup ----------------------------------------------------------------------------------


def near_copies():
    """Groups of edited copies around the threshold, some reached only through others."""
    random.seed(11)
    out = []
    for group in range(12):
        words = [f"g{group}w{i}" for i in range(60)]
        for _ in range(12):
            copy = list(words)
            for _ in range(random.randrange(4)):
                copy[random.randrange(60)] = f"e{random.random()}"
            out.append(" ".join(copy))
    out += [t.upper() for t in out[:5]]
    return list(enumerate(out))


@pytest.mark.parametrize("small,block", [(200, 1000), (3, 5)])
def test_near_dedup(spark, docs, rows, odd, small, block, monkeypatch):
    """Also with nodes that count as large, which branch or are cut into blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", block << 12)
    edited = near_copies()
    for df, plain in ((docs, rows), (odd, [(r[0], r[1]) for r in awkward()]), (spark.createDataFrame(edited, "doc_id long, text string"), edited)):
        want = brute.near_dedup(plain)
        got = near_dedup.near_dedup(df).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(plain)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def half_alike(n):
    """Texts with 75 of 100 words in common, which no token divides well, and a near copy of every tenth."""
    common = [f"common{i}" for i in range(75)]
    out = [common + [f"d{d}w{i}" for i in range(25)] for d in range(n)]
    for words in out[::10]:
        out.append([*words[:90], "changed", *words[91:]])
    return [(i, " ".join(words)) for i, words in enumerate(out)]


@pytest.mark.parametrize("block,size", [(1000, 4 << 20), (60, 1 << 15)])
def test_near_dedup_of_half_alike_texts(spark, block, size, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", size)
    plain = half_alike(400)
    got = near_dedup.near_dedup(spark.createDataFrame(plain, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_dedup(plain)


@pytest.mark.parametrize("step", [1, 250, 1 << 17])
def test_sets_count_by_value_where_places_clash(step, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(near_dedup, "STEP", step)
    rows = [np.arange(100), np.arange(100) + near_dedup.PLACES, np.arange(8, 108), np.arange(1, 101)]  # the second has the places of the first
    sets = near_dedup.Sets(pa.array([sorted(r.tolist()) for r in rows], pa.list_(pa.int64())))
    assert sets.similar(0, np.array([1, 2, 3]), 85) == [2, 3]
    assert sets.similar(0, np.array([1, 2, 3]), 90) == [3]


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_lose_hardly_any_link(percent):
    """Of pairs exactly at the threshold, fewer than one in a million have too few equal tokens to be compared."""
    import math
    from types import SimpleNamespace

    import numpy as np

    n = near_dedup.TOKENS
    sketch = np.tril(np.ones((n + 1, n), np.uint32), -1)  # row k has k ones
    block = SimpleNamespace(sketch=np.vstack([sketch, np.ones((1, n), np.uint32)]), size=np.full(n + 2, 100))
    lost = near_dedup.passes(block, slice(0, n + 1), n + 1, percent) < 0
    p = percent / 100
    assert lost[0] and sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in np.flatnonzero(lost).tolist()) < 1e-6


def test_near_dedup_of_rows_without_ids(repeated):
    got = found(near_dedup.near_dedup(repeated), "doc_id", "component_id", "kept")
    assert got == [(3, 3, True), (7, 7, True), (7, 7, True), (None, 7, False), (None, None, True), (None, None, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 104)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- mixing --------------------------------------------------------------------------------------


def test_targets_and_quotas():
    import numpy as np

    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    assert mixing.targets([10, 1000], [3, 1]) == [30.0, 980.0]
    assert mixing.targets([], [1]) == [] and mixing.targets([0, 0], [1, 2]) == [0.0, 0.0]
    random.seed(2)
    for _ in range(100):
        votes = [random.randrange(1, 50) for _ in range(random.randrange(1, 6))]
        most = [random.randrange(8) for _ in votes]
        seats, want = random.randrange(20), [0] * len(votes)
        for _ in range(min(seats, sum(most))):
            open_ = [i for i in range(len(votes)) if want[i] < most[i]]
            want[max(open_, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(np.array(votes), seats, np.array(most)).tolist() == want


def test_mixing(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.mix(docs).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    by = {}
    for r in got:
        assert r.size == len(text[r.doc_id].encode().split()) and 0 <= r.taken <= 3 * r.size
        total = by.setdefault(r.source, [0, r.target, r.source_size, 0])
        total[0] += r.taken
        total[3] += r.size
    assert all(abs(t - target) <= 2 * mixing.BLOCK_WORDS and size == own for t, target, size, own in by.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    only = mixing.mix(odd).collect()
    assert len(only) == odd.count() and all(r.source is None for r in only) and mixing.mix(odd.limit(0)).count() == 0


def test_quotas_add_up():
    import numpy as np

    random.seed(4)
    for _ in range(200):
        sizes = [random.choice([0, random.randrange(1, 9), random.randrange(1, 500)]) for _ in range(random.randrange(1, 8))]
        most = 3 * np.array(sizes)
        target = np.array(mixing.targets(sizes, [random.randrange(1, 4) for _ in sizes]))
        words = round(target.sum())
        got = mixing.quotas(target, words, most, mixing.BLOCK_WORDS)
        assert got.sum() == min(words, most.sum()) and (got <= most).all() and (got[target == most] == most[target == most]).all()
        assert (abs(got - target) <= 2 * mixing.BLOCK_WORDS).all() and (got[target >= 1.5] > 0).all()


def test_tiny_sources_take_their_targets(spark):
    """Sources of five words, of which a large one leaves most their ceiling, and many that share alike."""
    big = [(1000 + i, "w " * 200, "big") for i in range(20)]
    tiny = [(i, "a b c d e", f"tiny{i:03}") for i in range(100)]
    schema = "doc_id long, text string, source string"
    for rows, want in ((big + tiny, 15), (tiny, None)):
        got = mixing.mix(spark.createDataFrame(rows, schema), weights=[1.0]).collect()
        few = [r for r in got if r.source != "big"]
        assert all(abs(r.taken - r.target) <= 1 and r.taken > 0 for r in few) and sum(r.taken for r in got) == sum(r.size for r in got)
        assert want is None or all(r.taken == want for r in few)


# -- fingerprints --------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [fingerprints.RANGE_BYTES, 2000])
def test_fingerprints(docs, rows, odd, size, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
    for df, plain in ((docs, rows), (odd, [(r[0], r[1]) for r in awkward()])):
        text = {d: t or "" for d, t in plain}
        ids = sorted(text, reverse=True)
        got = {r.doc_id: r for r in fingerprints.likenesses(df).collect()}
        assert len(got) == len(ids)
        for doc, following in zip(ids, ids[1:] + ids[:1]):
            own, row = text[doc], got[doc]
            third = len(own) // 3
            changed = own[: len(own) - third] + text[following][:third]
            assert row.n_chars == len(own) and row.edited_sha256 == brute.sha(changed)
            a, b, c = brute.shingles(own), brute.shingles(changed), brute.shingles(text[following])
            for near, other in ((row.near_edited, b), (row.near_next, c)):
                # Exact where the sketch holds everything, else within four standard deviations.
                assert abs(near - brute.resemblance(a, other)) <= (1e-9 if len(a | other) <= fingerprints.K else 0.18)


def test_sketches_merge(spark):
    texts = [" ".join(f"w{random.randrange(50)}" for _ in range(300)) for _ in range(3)]
    one, two, _ = fingerprints.sketches(texts)
    both = fingerprints.merged(one, two)
    exact = brute.shingles(texts[0]) | brute.shingles(texts[1])
    assert abs(fingerprints.distinct(both) / len(exact) - 1) < 0.4
    assert fingerprints.from_text(fingerprints.to_text(one)).tolist() == one.tolist()
    small = fingerprints.sketches(["a b c d e f", "a b c d e f g"])
    assert fingerprints.containment(*small) == 1.0 and fingerprints.resemblance(*small) == 2 / 3
    df = spark.createDataFrame([("x", texts[0]), ("x", texts[1]), (None, None)], "source string, text string").repartition(2)
    got = {r.source: r.fingerprint for r in fingerprints.group_fingerprints(df, "source").collect()}
    assert got == {"x": fingerprints.to_text(both), None: ""}


def test_repeated_ids_follow_each_other(repeated):
    got = found(fingerprints.likenesses(repeated), "doc_id", "near_next")
    assert len(got) == 6 and (7, 1.0) in got


# -- empty tables --------------------------------------------------------------------------------


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    path = public_tokenizers.path("piece_bpe_32k.model")
    for made in (
        substring_dedup.substring_dedup(none), passage_dedup.passage_dedup(none), pieces.encode(none, path), near_dedup.near_dedup(none),
        token_counts.token_counts(none, public_tokenizers.path("word_bpe_49k.json")), fingerprints.likenesses(none), exact_dedup.exact_dedup(none),
        fingerprints.fingerprint(none),
    ):
        assert made.count() == 0
