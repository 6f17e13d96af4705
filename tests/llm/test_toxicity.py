"""Toxicity scores against a plain Kneser-Ney model, on awkward rows, and on labels the models never see."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidflow.llm import toxicity as tx

LABELS = "doc_id long, toxic int"
DOCS = "doc_id long, text string"


def role(doc):
    h = zlib.crc32(str(doc).encode())
    return "held out" if h % 4 == 2 else "curve" if h // 4 % tx.CURVE_SHARE == 0 else "model"


def plain(docs, classes, order=tx.ORDER, d=tx.DISCOUNT):
    """doc_id -> evidence, with the recursion of the model written out."""
    counts = [collections.Counter(), collections.Counter()]
    for doc, text in docs:
        if doc is not None and role(doc) == "model" and doc in classes:
            for word in tx.words_of(text or ""):
                counts[classes[doc]].update(tx.grams_of(word, order))
    levels = {order: set(counts[0]) | set(counts[1])}
    lower = {}
    for k in range(order - 1, 0, -1):
        lower[k] = collections.Counter(g[1:] for g in levels[k + 1])
        levels[k] = set(lower[k])

    def shared(gram):
        if not gram:
            return 1 / (len(levels[1]) + 1)
        same = [n for g, n in lower[len(gram)].items() if g[:-1] == gram[:-1]]
        return (max(lower[len(gram)][gram] - d, 0) + d * len(same) * shared(gram[1:])) / sum(same)

    def ratio(gram):
        out = []
        for own in counts:
            same = [n for g, n in own.items() if g[:-1] == gram[:-1]]
            p = shared(gram[1:]) if gram in levels[order] else 1.0
            out.append((max(own[gram] - d, 0) + d * len(same) * p) / sum(same) if same else p)
        return math.log(out[1] / out[0])

    kept, found = {}, []
    for doc, text in docs:
        words = collections.Counter(tx.words_of(text or ""))
        of = {}
        for word in words:
            of[word] = sum(kept[g] if g in kept else kept.setdefault(g, ratio(g)) for g in tx.grams_of(word, order))
        top = sorted(of.values(), reverse=True)
        letters = sum((len(w) + 1) * n for w, n in words.items())
        mean = sum(of[w] * n for w, n in words.items()) / max(1, letters)
        found.append((doc, mean, sum(top[:1]), sum(top[: tx.FEW]) / tx.FEW, sum(top[: tx.MANY]) / tx.MANY, math.log1p(sum(words.values()))))
    return sorted(found, key=str)


def made_up(n=80):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["the", "them", "then", "Other", "oath", "ah", "naïve"], k=rng.randrange(40)))) for i in range(n)]
    docs += [(n + i, " ".join(rng.choices(["the", "then", "bah", "bahs", "Bäh"], k=12))) for i in range(n)]
    docs += [(9000, None), (9001, ""), (9002, " \n.,!"), (9003, "y" * 30_000), (9004, "bah the " * 20_000), (None, "the bah"), (3, "other row of 3"), (3, "other row of 3")]
    return docs, {**{i: 0 for i in range(0, n)}, **{n + i: 1 for i in range(n)}, 9000: 1, 9004: 1}


def found(df):
    return sorted(((r.doc_id, *[r[f] for f in tx.FEATURES]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [None, 500])
def test_evidence_against_a_plain_model(spark, block, monkeypatch):
    """In one block and in many; rows repeat, lack an id, or have long, empty or no text; labels repeat or name nothing."""
    if block:
        monkeypatch.setattr(tx, "BLOCK_BYTES", block)
        monkeypatch.setattr(tx, "BUFFER_BYTES", block)
    docs, classes = made_up()
    labels = [*classes.items(), (0, 0), (None, 1), (77_777, 1), (1, None)]
    given = spark.createDataFrame(docs, DOCS).withColumns({"block": F.lit("b"), "rows": F.lit(1), "toxic": F.lit(5), "gram": F.lit("g")}).repartition(3)
    marks = spark.createDataFrame(labels, LABELS).withColumns({"text": F.lit("t"), "held_out": F.lit(1)})
    rows = found(tx.toxicity(given, marks))
    for own, other in zip(rows, plain(docs, classes)):
        assert own[0] == other[0]
        assert own[1:] == pytest.approx(other[1:], abs=1e-9)


def test_held_out_labels_are_not_used(spark):
    docs, classes = made_up()
    given = spark.createDataFrame(docs, DOCS)
    wrong = {d: (1 - c if role(d) == "held out" else c) for d, c in classes.items()}
    first, second = (
        sorted(((r.doc_id, r.score, r.held_out) for r in tx.toxicity(given, spark.createDataFrame(list(c.items()), LABELS)).collect()), key=str)
        for c in (classes, wrong)
    )
    assert first == second
    assert all(h == (d is not None and role(d) == "held out") for d, _, h in first)


@pytest.mark.parametrize("labels", [[], [(i, 0) for i in range(160)], [(i, None) for i in range(160)]])
def test_labels_of_one_class_or_none(spark, labels):
    rows = tx.toxicity(spark.createDataFrame(made_up()[0], DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(made_up()[0])
    assert all(0 <= r.score < 0.01 and r.predicted == 0 for r in rows)


def test_empty_table(spark):
    assert tx.toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1)], LABELS)).count() == 0


def test_equal_texts_have_equal_scores(spark):
    docs, classes = made_up()
    rows = tx.toxicity(spark.createDataFrame(docs + [(d + 500 if d is not None else None, t) for d, t in docs], DOCS), spark.createDataFrame(list(classes.items()), LABELS)).collect()
    texts = collections.defaultdict(set)
    by_id = dict(docs + [(d + 500, t) for d, t in docs if d is not None])
    for r in rows:
        if r.doc_id is not None and r.doc_id != 3 and r.doc_id != 503:
            texts[by_id[r.doc_id]].add(r.score)
    assert all(len(scores) == 1 for scores in texts.values())


def test_curve_follows_the_likelihood():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, len(tx.FEATURES)))
    true = np.array([2.0, -1.0, 0.5, 0.0, 1.0, -0.7])
    toxic = (rng.random(4000) < 1 / (1 + np.exp(-(x @ true[:-1] + true[-1])))).astype(float)
    assert tx.curve(x, toxic, 0) == pytest.approx(true, abs=0.25)


def test_held_out_accuracy(spark):
    """Rows whose labels no step has seen: most toxic texts are caught and ordinary ones left alone."""
    folder = "/root/testdata/sf0.1"
    rows = tx.op12_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert rows.predicted[rows.toxic == 1].mean() > 0.85
    assert rows.predicted[rows.toxic == 0].mean() < 0.02
