"""Operator 12, toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary texts have a model each over the letters of words: counts of n-grams of the class are
discounted, and what the discount frees goes to a lower-order distribution that both classes share, counted
from the contexts an n-gram follows. Rare expressions therefore weigh nothing for or against a class. A text's
evidence are its length-normalised log-likelihood ratio and those of its most toxic words, since a few of them
vanish in the mean of a long text; a logistic curve, fitted on labelled rows the models have not seen, turns
them into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm.language import held_out
from bidflow.llm.shared import bytes_of, pieces, table, text_of, total_bytes
from bidflow.operators.sizing import materialize

ORDER = 4
DISCOUNT = 0.75
#: Of the labelled rows to learn from, one in so many is kept from the models and used for the curve.
CURVE_SHARE = 5
#: At most so many rows, chosen by a hash of their id, fit the four numbers of the curve.
CURVE_ROWS = 50_000
THRESHOLD = 0.3
BLOCK_BYTES = 16 << 20
BUFFER_BYTES = 32 << 20
FEATURES = ("mean", "most", "few", "many", "size")
FEW, MANY = 3, 8

_WORD = re.compile(r"\w+")
_START, _END = "\x02", "\x03"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, order: int) -> list[str]:
    """The n-grams that end at each letter of a word and at its end."""
    padded = _START * (order - 1) + word + _END
    return [padded[i : i + order] for i in range(len(word) + 1)]


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")


def for_curve() -> Column:
    """Rows kept from the models, so that the curve is fitted on texts they have not seen."""
    return (F.floor(F.crc32(_id()) / 4) % CURVE_SHARE) == 0


def class_of(labels: DataFrame) -> DataFrame:
    """doc_id, toxic (0 or 1) of labels to learn from: those not held out, of several for an id the largest."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    return usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def _compressed(parts: list[pa.RecordBatch]) -> bytes:
    import zstandard

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema) as writer:
        for part in parts:
            writer.write_batch(part)
    return zstandard.compress(sink.getvalue(), 3)


def _unpacked(blob: bytes) -> pa.Table:
    import zstandard

    return pa.ipc.open_stream(zstandard.decompress(blob)).read_all()


def _in_blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Numbered blocks of consecutive rows of a task, near a limit of bytes of text (one row at least)."""
    partition = TaskContext.get().partitionId() << 32
    number, held, size = 0, [], 0
    for piece in pieces(batches, "text", limit):
        held.append(piece)
        size += len(bytes_of(piece.column(piece.schema.get_field_index("text")))[0])
        if size >= limit:
            yield partition + number, held
            number, held, size = number + 1, [], 0
    if held:
        yield partition + number, held


def settled(docs: DataFrame) -> DataFrame:
    """docs, written first if its plan shuffles: blocks are numbered by task, so both passes must see the same tasks."""
    return materialize(docs) if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def packed(docs: DataFrame) -> DataFrame:
    """block, rows: the (doc_id, held_out, text) of each block, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _in_blocks(batches, BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_compressed(parts)], pa.binary())], ["block", "rows"])

    return docs.mapInArrow(pack, "block long, rows binary")


def asked(docs: DataFrame, order: int) -> DataFrame:
    """block, gram: the n-grams of the words of each block, each once."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _in_blocks(batches, BLOCK_BYTES):
            words: set[str] = set()
            for part in parts:
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    words.update(words_of(text))
            grams: set[str] = set()
            for word in words:
                grams.update(grams_of(word, order))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block)), pa.array(sorted(grams), pa.string())], ["block", "gram"])

    return docs.mapInArrow(ask, "block long, gram string")


def counted(docs: DataFrame, classes: DataFrame, order: int) -> DataFrame:
    """gram, c0, c1: how often words of ordinary and of toxic texts have each n-gram.

    Texts (doc_id, text) and classes (doc_id, toxic) meet in blocks dealt by a hash of doc_id; a task sends what it
    has for a block as one compressed row. A block counts its own n-grams before they are added up.
    """
    blocks = max(1, total_bytes(docs) // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _in_blocks(batches, BUFFER_BYTES):
            whole = pa.Table.from_batches(parts).sort_by("block").combine_chunks()
            names, starts = np.unique(whole.column("block").to_numpy(), return_index=True)
            for name, start, stop in zip(names.tolist(), starts, [*starts[1:], whole.num_rows]):
                blob = _compressed(whole.slice(start, stop - start).to_batches())
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([blob], pa.binary())], ["block", "rows"])

    def count(key, rows: pa.Table, labels: pa.Table) -> pa.Table:
        known = dict(zip(labels.column("doc_id").to_pylist(), labels.column("toxic").to_pylist()))
        words = (Counter(), Counter())
        for part in map(_unpacked, rows.column("rows").to_pylist() if known else ()):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                if doc in known:
                    words[known[doc]].update(words_of(text))
        grams: dict[str, list[int]] = {}
        for kind, found in enumerate(words):
            for word, n in found.items():
                for gram in grams_of(word, order):
                    own = grams.get(gram)
                    if own is None:
                        own = grams[gram] = [0, 0]
                    own[kind] += n
        n = np.array(list(grams.values()), np.int64).reshape(-1, 2)
        return pa.table([pa.array(list(grams), pa.string()), pa.array(n[:, 0]), pa.array(n[:, 1])], ["gram", "c0", "c1"])

    texts = docs.select(block, "doc_id", "text").mapInArrow(deal, "block long, rows binary")
    met = texts.groupBy("block").cogroup(classes.select(block, "doc_id", "toxic").groupBy("block"))
    each = met.applyInArrow(count, "gram string, c0 long, c1 long")
    return each.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def shared_backoff(seen: DataFrame, order: int, discount: float) -> DataFrame:
    """tail, p: the probability of the last letter of each (order - 1)-gram by counts that both classes share.

    A gram's count is the number of different letters it follows in the grams one longer (Kneser-Ney), down
    to single letters, which are smoothed with an equal share for each letter and one more.
    """
    levels, grams = [], seen.select("gram")
    for _ in range(order - 1):
        grams = grams.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.append(grams)
    p = None
    for size, level in enumerate(reversed(levels), 1):
        head = F.left("gram", F.lit(size - 1))
        totals = level.groupBy(head.alias("head")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
        joined = level.withColumn("head", head).join(totals, "head")
        if p is None:
            below = joined.withColumn("p", 1 / (F.col("types") + 1))
        else:
            below = joined.withColumn("tail", F.expr("substring(gram, 2)")).join(p, "tail")
        value = (F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("types") * F.col("p")) / F.col("total")
        p = below.select(F.col("gram").alias("tail"), value.alias("p"))
    return p


def ratios(grams: DataFrame, seen: DataFrame, order: int, discount: float) -> DataFrame:
    """gram, ratio: log of the probabilities of a gram's last letter after the others, toxic to ordinary.

    seen (gram, c0, c1) are the counts of the classes. A context that a class has not seen gives what the shared
    distribution gives. For a gram that neither class has, that distribution stands in both and cancels.
    """
    head = F.left("gram", F.lit(order - 1)).alias("head")
    contexts = seen.groupBy(head).agg(
        F.sum("c0").alias("s0"), F.sum("c1").alias("s1"),
        F.count_if(F.col("c0") > 0).alias("t0"), F.count_if(F.col("c1") > 0).alias("t1"),
    )
    tails = shared_backoff(seen, order, discount)
    rows = grams.select("gram", head, F.expr("substring(gram, 2)").alias("tail")).join(seen, "gram", "left").na.fill(0, ["c0", "c1"])
    rows = rows.join(contexts, "head", "left").join(tails, "tail", "left")
    p = F.when(F.col("c0") + F.col("c1") > 0, F.col("p")).otherwise(1.0)

    def in_class(k: int) -> Column:
        own = F.greatest(F.col(f"c{k}") - discount, F.lit(0.0)) + discount * F.col(f"t{k}") * p
        return F.when(F.col(f"s{k}") > 0, own / F.col(f"s{k}")).otherwise(p)

    return rows.select("gram", F.log(in_class(1) / in_class(0)).alias("ratio"))


def evidence(docs: DataFrame, labels: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """doc_id, held_out, mean, most, few, many, size of every row of docs.

    mean is the log-likelihood ratio per letter; most, few and many are the largest, the largest FEW and the
    largest MANY ratios of different words, summed and divided by their number; size is the logarithm of one
    more than the number of words. A text without words has zeros. Texts are shuffled once, compressed, and those
    the models learn from once more; of the models each block gets the n-grams its own texts have, by a join, so
    no task or driver holds a model.
    """
    rows = settled(docs).select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    learned = rows.filter(F.col("doc_id").isNotNull() & ~held_out() & ~for_curve())
    seen = materialize(counted(learned, class_of(labels).filter(~for_curve()), order))
    wanted = materialize(asked(rows, order))
    answers = wanted.join(ratios(wanted.select("gram").distinct(), seen, order, discount), "gram").select("block", "gram", "ratio")

    def weigh(key, rows: pa.Table, answers: pa.Table) -> pa.Table:
        ratio = dict(zip(answers.column("gram").to_pylist(), answers.column("ratio").to_pylist()))
        per_word: dict[str, tuple[float, int]] = {}
        out = []
        for part in map(_unpacked, rows.column("rows").to_pylist()):
            found = []
            for text in part.column("text").to_pylist():
                own = Counter(words_of(text))
                for word in own:
                    if word not in per_word:
                        per_word[word] = sum([ratio[g] for g in grams_of(word, order)]), len(word) + 1
                each = np.array([(*per_word[word], n) for word, n in own.items()]).reshape(-1, 3)
                top = -np.sort(-each[:, 0])[:MANY]
                mean = each[:, 0] @ each[:, 2] / max(1, each[:, 1] @ each[:, 2])
                found.append((mean, top[:1].sum(), top[:FEW].sum() / FEW, top.sum() / MANY, np.log1p(each[:, 2].sum())))
            values = np.array(found).reshape(-1, len(FEATURES))
            columns = [part.column("doc_id"), part.column("held_out"), *[pa.array(x) for x in values.T]]
            out.append(pa.table(columns, ["doc_id", "held_out", *FEATURES]))
        empty = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(f, pa.float64()) for f in FEATURES]])
        return pa.concat_tables(out) if out else empty.empty_table()

    schema = "doc_id long, held_out boolean, " + ", ".join(f"{f} double" for f in FEATURES)
    return packed(rows).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(weigh, schema)


def curve(rows: np.ndarray, toxic: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights of the features and a constant, by Newton's method on the penalised logistic likelihood.

    With one class or no rows the weights are zero and the constant gives the share of toxic rows, at
    most 12 either way.
    """
    weights = np.zeros(len(FEATURES) + 1)
    share = toxic.mean() if len(toxic) else 0.0
    if share in (0.0, 1.0):
        weights[-1] = 12.0 if share else -12.0
        return weights
    middle, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    x = np.c_[(rows - middle) / scale, np.ones(len(rows))]
    ridge = penalty * len(rows) * np.append(np.ones(len(FEATURES)), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, x.T @ (toxic - p) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-10:
            break
    own = weights[:-1] / scale
    return np.append(own, weights[-1] - own @ middle)


def toxicity(docs: DataFrame, labels: DataFrame, order: int = ORDER, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from the threshold on), and the evidence of every row of docs.

    labels (doc_id, toxic) may name some documents; other columns of both are ignored. Null texts count as
    empty; without words the score is that of texts without evidence. Rows are scored alone, so repeated rows
    and equal texts get equal scores. Without labels to learn from every score is near 0.
    """
    found = materialize(evidence(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), order))
    sample = (
        found.join(class_of(labels).filter(for_curve()), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES)
        .limit(CURVE_ROWS).select(*FEATURES, "toxic").toPandas()
    )
    weights = curve(sample[list(FEATURES)].to_numpy(float), sample["toxic"].to_numpy(float))
    total = sum((F.col(f) * float(w) for f, w in zip(FEATURES, weights)), F.lit(float(weights[-1])))
    score = 1 / (1 + F.exp(-total))
    return found.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"), *FEATURES)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")
