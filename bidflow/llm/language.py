"""Operator 2, language identification as mixture inference.

A language is a distribution over hashed letter trigrams. Expectation-maximisation estimates each
document's language proportions; languages are added to the document's set in order of proportion
while the likelihood gains more than a penalty that grows with the document's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidflow.llm.shared import pieces, table, text_of

FEATURES = 4096
SMOOTHING = 0.5
ROUNDS = 15
REFITS = 8
#: Log-likelihood that another language must bring, per logarithm of the number of trigrams. Each letter
#: counts in three trigrams, so the usual one half is tripled.
PENALTY = 1.5
DOCS_AT_ONCE = 256
UNDETERMINED = "und"

_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed trigrams of lower-case letters, one row per text; all else counts as a space."""
    raw = [b" " + t.lower().encode() + b" " for t in texts]
    sizes = np.array([len(r) for r in raw])
    data = _KEEP[np.frombuffer(b"".join(raw), np.uint8)]
    doc = np.repeat(np.arange(len(raw)), sizes)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (doc[1:] != doc[:-1])
    data, doc = data[keep].astype(np.uint32), doc[keep]
    if len(data) < 3:
        return np.zeros((len(raw), FEATURES), np.float32)
    gram = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    code = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
    same = doc[:-2] == doc[2:]
    counts = np.bincount(doc[:-2][same] * FEATURES + code[same], minlength=len(raw) * FEATURES)
    return counts.reshape(len(raw), FEATURES).astype(np.float32)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Trigram probabilities of each label, from all rows given (text, lang); rows with a null are left out.

    Each task sums its own counts, so what is shuffled and what the driver gets is at most one number
    per label and feature, whatever the number of rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text"):
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for at in range(0, len(texts), DOCS_AT_ONCE):
                counts = trigram_counts(texts[at : at + DOCS_AT_ONCE])
                part = langs[at : at + DOCS_AT_ONCE]
                for lang in set(part):
                    sums[lang] = sums.get(lang, 0) + counts[part == lang].sum(axis=0, dtype=np.float64)
        for lang, counts in sums.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(counts[seen].astype(np.int64))],
                ["lang", "feature", "n"],
            )

    rows = (
        docs.select("text", "lang").dropna().mapInArrow(count, "lang string, feature int, n long")
        .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    )
    langs = sorted(set(rows.column("lang").to_pylist()))
    where = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((len(langs), FEATURES))
    index = np.array([where[x] for x in rows.column("lang").to_pylist()], int)
    counts[index, np.array(rows.column("feature"))] = np.array(rows.column("n"))
    return langs, (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)


def refine(counts: np.ndarray, shares: np.ndarray, model: np.ndarray, rounds: int) -> np.ndarray:
    """Expectation-maximisation of the shares of languages; a share of zero stays zero."""
    for _ in range(rounds):
        shares = shares * ((counts / (shares @ model)) @ model.T)
        shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1e-30)
    return shares


def likelihood(counts: np.ndarray, shares: np.ndarray, model: np.ndarray) -> np.ndarray:
    return (counts * np.log(shares @ model)).sum(axis=1)


def infer(counts: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of languages per row of counts (sums to one, zero outside the chosen set), and how sure the
    largest one is against the next as the only language."""
    n, languages = len(counts), len(model)
    shares = np.full((n, languages), 1 / languages, np.float32)
    shares = refine(counts, shares, model, ROUNDS)
    order = np.argsort(-shares, axis=1, kind="stable")
    chosen = np.zeros_like(shares)
    chosen[np.arange(n), order[:, 0]] = 1
    alone = counts @ np.log(model).T
    if languages == 1:
        return chosen, np.ones(n)
    best = alone[np.arange(n), order[:, 0]]
    sure = 1 / (1 + np.exp(np.clip(alone[np.arange(n), order[:, 1]] - best, -50, 50)))
    at, value = np.arange(n), best
    for size in range(2, languages + 1):
        start = np.zeros((len(at), languages), np.float32)
        np.put_along_axis(start, order[at, :size], np.float32(1 / size), axis=1)
        fitted = refine(counts[at], start, model, REFITS)
        gained = likelihood(counts[at], fitted, model)
        better = gained - value > PENALTY * np.log1p(counts[at].sum(axis=1))
        at, value = at[better], gained[better]
        chosen[at] = fitted[better]
        if not len(at):
            break
    return chosen, sure


def identify(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """All columns of docs with lang_pred, score (share of the language times how sure it is) and shares (map).

    A null text, a text without a letter and any text under a model without languages is `und` with
    score 0 and no shares. Ties go to the smaller label. Rows are independent; no shuffle. Columns of the
    same names in docs are replaced.
    """
    small = np.ascontiguousarray(model, np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                texts = part.column(part.num_columns - 1).to_pylist()
                some = [i for i, t in enumerate(texts) if langs and any(map(str.isalpha, t))]
                pred, score, shares = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                if some:
                    chosen, sure = infer(trigram_counts([texts[i] for i in some]), small)
                    top = chosen.argmax(axis=1)
                    for row, i in enumerate(some):
                        pred[i], score[i] = langs[top[row]], min(1.0, float(chosen[row, top[row]] * sure[row]))
                        shares[i] = [(langs[k], float(chosen[row, k])) for k in np.flatnonzero(chosen[row])]
                out = [
                    pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                    pa.array(shares, pa.map_(pa.string(), pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *out], [*part.schema.names[:-1], "lang_pred", "score", "shares"])

    kept = docs.drop("lang_pred", "score", "shares", "_text")
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("shares", T.MapType(T.StringType(), T.DoubleType()))]
    schema = T.StructType([*kept.schema.fields, *[T.StructField(*a) for a in added]])
    source = kept.withColumn("_text", text_of() if "text" in docs.columns else F.lit(""))
    return source.mapInArrow(run, schema)


def held_out():
    """Documents that training never sees; a null id counts as the empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, model = train(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), langs, model).select(
        "doc_id", "held_out", "lang_pred", "score"
    )
