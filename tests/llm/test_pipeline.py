"""The corpus pipeline, stage by stage, against plain versions on each stage's own input."""

import brute
import pytest
import public_tokenizers
import sentencepiece

import corpus_pipeline
from test_operators import awkward

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What went into each stage and what came out of the last, as rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toArrow())
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_columns_stay(stages):
    assert all(list(rows[0].asDict()) == COLUMNS for rows in stages[:-1])


def test_language_keeps_clean_documents(stages):
    assert len(stages[1]) >= 0.97 * len(stages[0]) and set(ids(stages[1])) <= set(ids(stages[0]))


def test_exact_copies_go(stages):
    first = {}
    for r in sorted(stages[1], key=lambda r: r.doc_id):
        first.setdefault(normal(r.text), r.doc_id)
    assert ids(stages[2]) == sorted(first.values())


def normal(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_near_copies_go(stages):
    want = brute.near_dedup([(r.doc_id, r.text) for r in stages[2]], corpus_pipeline.SIMILARITY)
    assert ids(stages[3]) == sorted(d for d, (_, component) in want.items() if d == component)


def test_mixture(stages):
    size = {r.doc_id: len((r.text or "").encode().split()) for r in stages[3]}
    copies = {}
    for r in stages[4]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= set(size) and max(copies.values()) <= 3
    assert abs(sum(size[r.doc_id] for r in stages[4]) / sum(size.values()) - 1) < 0.1


def test_encoding(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r.doc_id, library.encode(r.text or "") + [library.eos_id()]) for r in stages[4])
    assert sorted((r.doc_id, r.ids) for r in stages[5]) == want


def test_run_gives_the_same(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.ids_sha256) for r in got.collect()) == sorted((r.doc_id, r.ids_sha256) for r in stages[5])


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_awkward_rows(spark, sf_dir, number):
    """Nulls, repeated rows, rows without ids, clashing names, and no rows at all."""
    rows = awkward()[:20] + [(0, "x y", "en", "s", 1), (0, "x y", "en", "s", 1), (None, "x y z", "en", None, 1), (None, "x y z", "en", None, 1)]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c in ('text', 'lang', 'source') else 'long'}" for c in COLUMNS))
    docs = docs.withColumns({"score": F.lit("own"), "_rows": F.lit("own"), "size": F.lit("own"), "digest": F.lit("own")})
    name, stage = corpus_pipeline.STAGES[number]
    made = stage(spark, docs, sf_dir)
    if number < len(corpus_pipeline.STAGES) - 1:
        assert made.columns == docs.columns
    made.collect()
    if name == "exact dedup":
        assert made.filter("text = 'x y z'").count() == 1 and made.filter("text = 'x y'").count() == 1
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_bilingual_documents_stay(spark, sf_dir):
    """A document whose language has half of the text or more stays, however unsure that language is."""
    from pyspark.sql import functions as F

    from bidflow.llm import language

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = docs.filter(~language.held_out())
    by = {}
    for r in docs.filter("length(text) > 1200").orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r.text)
    # Above all held-out ids and labelled null, so that the model is learned from the documents only.
    pairs = [(a, b) for a in sorted(by) for b in sorted(by) if a != b]
    made = [(10**9 + i, x[:660] + " " + y[:540], None, "s", 1200) for i, (x, y) in enumerate((x, y) for a, b in pairs for x, y in zip(by[a][:4], by[b][:4]))]
    mixtures = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").select(docs.columns)
    langs, model = language.train(labelled)
    seen = language.identify(mixtures, langs, model).collect()
    want = sorted(r.doc_id for r in seen if r.shares[r.lang_pred] >= 0.5)
    assert any(r.shares[r.lang_pred] >= 0.5 and r.score < 0.1 for r in seen)
    kept = corpus_pipeline.by_language(spark, docs.unionByName(mixtures), sf_dir).filter(F.col("doc_id") >= 10**9)
    assert ids(kept.collect()) == want


def test_no_document_has_a_language_without_labels(spark, sf_dir):
    from pyspark.sql import functions as F

    from bidflow.llm import language

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for unlabelled in (docs.withColumn("lang", F.lit(None).cast("string")), docs.filter(language.held_out())):
        assert unlabelled.count() and corpus_pipeline.by_language(spark, unlabelled, sf_dir).count() == 0
