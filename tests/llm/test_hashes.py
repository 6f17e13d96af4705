"""Hashes of runs of values: the definition, long data in steps, and texts that used to have one hash."""

import uuid

import numpy as np
import pytest
from bidflow.llm import exact_dedup, fingerprints, language, near_dedup, passage_dedup, shared


def twins(bits=10):
    """Two words of a and b: the parities of the bits of 0, 1, 2, ..., and the complement."""
    parity = [bin(i).count("1") % 2 for i in range(1 << bits)]
    return "".join("ab"[p] for p in parity), "".join("ba"[p] for p in parity)


@pytest.mark.parametrize("step", [None, 64])
@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
def test_span_hash_is_the_polynomial(step, kind, monkeypatch):
    if step:
        monkeypatch.setattr(shared, "STEP", step)
        monkeypatch.setattr(shared, "_POWERS", {})
    rng = np.random.default_rng(2)
    data = rng.integers(0, 255 if kind == np.uint8 else 2**64, 500, dtype=kind)
    starts = rng.integers(0, 480, 100)
    ends = starts + rng.integers(0, 20, 100)
    found = shared.span_hash(shared.prefix_sums(data), starts, ends)
    for start, end, h in zip(starts.tolist(), ends.tolist(), found.tolist()):
        value = sum((int(v) + 1) * pow(shared.BASE, i, shared.PRIME) for i, v in enumerate(data[start:end])) % shared.PRIME
        assert shared.mixed(np.array([value], np.uint64))[0] == h


def test_long_data_keeps_little_memory(monkeypatch):
    """The powers that stay with a worker are a few megabytes, and equal runs far apart have one hash."""
    monkeypatch.setattr(shared, "_POWERS", {})
    data = np.random.default_rng(3).integers(0, 255, 3 << 20, dtype=np.uint8)
    data[(5 << 18) - 50 : (5 << 18) + 50] = data[(2 << 20) + 7 : (2 << 20) + 107] = data[10:110]
    starts = np.array([10, (5 << 18) - 50, (2 << 20) + 7, 11])
    found = shared.span_hash(shared.prefix_sums(data), starts, starts + 100).tolist()
    assert found[0] == found[1] == found[2] != found[3]
    assert sum(table.nbytes for table in shared._POWERS.values()) <= 4 << 20


def test_twins_differ(spark):
    one, other = twins()
    rest = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{other} {rest}")], "doc_id long, text string")
    assert [r.n_removed for r in passage_dedup.passage_dedup(docs).orderBy("doc_id").collect()] == [0, 0]
    words = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert [r.component_id for r in near_dedup.near_dedup(words).orderBy("doc_id").collect()] == [1, 2, 1]
    prints = [fingerprints.to_text(s) for s in fingerprints.sketches([one, other, one])]
    assert prints[0] == prints[2] != prints[1]


def test_numerals_are_no_letters(spark):
    texts = ["²", "½", "①", "Ⅷ 12", "a", None, "", "ß"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.train(spark.createDataFrame([("some text", "en"), ("ein Text", "de")], "text string, lang string"))
    found = {r.doc_id: r.lang_pred for r in language.identify(docs, *model).collect()}
    assert [found[i] == "und" for i in range(8)] == [True, True, True, True, False, True, True, False]


def test_an_earlier_row_without_an_id_wins(spark):
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", 4)
    batches = [[(None, "a b")], [(5, "a  b")], [(6, "a b"), (7, "c")]]
    found = [index.add(spark.createDataFrame(b, "doc_id long, text string")).select("doc_id", "keep_id", "kept").collect() for b in batches]
    assert [sorted(tuple(r) for r in rows) for rows in found] == [[(None, None, True)], [(5, None, False)], [(6, None, False), (7, 7, True)]]
