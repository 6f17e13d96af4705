"""Operator 11, alignment of two tokenizers by fragments that compose.

Texts up to a byte range are aligned where they are. Longer ones are cut into byte ranges, each of which gives
a fragment (open tokens, closed groups, open tokens) in a task of its own; fragments are composed in a tree, a
fixed number at a time, until one is left per text. How many documents link a pair is counted from the
distinct pairs of blocks of documents, and only those come back to a block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm import fragments as fr
from bidflow.llm.shared import bytes_of, pieces, table, text_of
from bidflow.llm.units import Tokenizers, load, units_of
from bidflow.operators.sizing import materialize, scratch_folder

#: Bytes of a range, and the number of fragments a task composes at once.
RANGE = 64 << 10
FAN = 16
PIECE = 1 << 19
BLOCK = 16 << 20

#: Places where both tokenizers start anew, whatever stands around: a space behind a visible ASCII character.
_SAFE = re.compile(rb"(?<=[!-~]) ")

STATS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<long>, times array<long>"
OPEN = tuple(f"{side}_{part}" for side in ("before", "after") for part in ("a", "a_len", "b", "b_len"))
FRAGMENT = (
    "row long, part long, doc_id long, fine boolean, cut boolean, n_a long, n_b long, n_groups long, n_links long, text binary, "
    "pairs array<long>, times array<long>, " + ", ".join(f"{name} array<long>" for name in OPEN)
)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    flat = np.concatenate([fr.NONE, *values])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _aligned(block, docs, stats, groups, digests, pairs, times) -> pa.RecordBatch:
    columns = [pa.array(block, pa.int64()), pa.array(docs, pa.int64()), *[pa.array(s, pa.int64()) for s in stats]]
    columns += [pa.array(groups, pa.string()), pa.array(digests, pa.string()), _lists(pairs), _lists(times)]
    return pa.RecordBatch.from_arrays(columns, ["block", "doc_id", *STATS, "groups", "groups_sha256", "pairs", "times"])


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest() if text else ""


def aligned_short(docs: DataFrame, a: bytes, b: bytes, with_groups: bool) -> DataFrame:
    """The alignment of each text of docs (doc_id, text), and its distinct linked pairs with how often they are linked.

    A block is a number of consecutive texts of a task. No shuffle; a task holds a piece of a batch and its table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(a, b)
        digits, base = fr.Digits(max(len(both.a_size), len(both.b_size))), len(both.b_size)
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in pieces(batches, "text", PIECE):
            size += len(bytes_of(batch.column(1))[0])
            if size > BLOCK:
                block, size = block + 1, 0
            tokens, a_runs, b_runs, _ = both.tokens([units_of(t) for t in batch.column(1).to_pylist()])
            runs = fr.align(tokens, a_runs, b_runs, digits)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(runs.links))
            span = len(both.a_size) * base
            codes, times = np.unique(doc * span + runs.link_a * base + runs.link_b, return_counts=True)
            ends = np.searchsorted(codes, np.arange(batch.num_rows + 1) * span)
            texts = [runs.text[s : max(s, e - 1)] for s, e in zip(runs.cuts[:-1].tolist(), runs.cuts[1:].tolist())]
            yield _aligned(
                np.full(batch.num_rows, block), batch.column(0), (np.diff(a_runs), np.diff(b_runs), runs.groups, np.diff(runs.links)),
                [t.decode() if with_groups else None for t in texts], [_digest(t) for t in texts],
                np.split(codes % span, ends[1:-1]), np.split(times, ends[1:-1]),
            )

    return docs.select("doc_id", "text").mapInArrow(run, ALIGNED)


def ranges_of(raw: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(low, high, start, stop) of the ranges of a text's bytes, and the safe places around each.

    A stretch without safe places that is longer than a range would be encoded again for every range that
    touches it; ranges end at its start instead.
    """
    safe = np.array([0, *(m.start() for m in _SAFE.finditer(raw)), len(raw)])
    lows = [0]
    for low in range(size, len(raw), size):
        at = np.searchsorted(safe, low, side="right") - 1
        lows.append(int(safe[at]) if safe[at + 1] - safe[at] > size else low)
    lows = sorted(set(lows))
    highs = [*lows[1:], len(raw)]
    return [
        (low, high, int(safe[np.searchsorted(safe, low, side="right") - 1]), int(safe[np.searchsorted(safe, high)]))
        for low, high in zip(lows, highs)
    ]


def ranges(docs: DataFrame, size: int) -> DataFrame:
    """row, part, doc_id, low, high, start, raw: the ranges of texts (row, doc_id, text) with the bytes around them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            for row, doc, text in zip(*[c.to_pylist() for c in batch.columns]):
                raw = b" " + text.encode()
                for part, (low, high, start, stop) in enumerate(ranges_of(raw, size)):
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array([v], pa.int64()) for v in (row, part, doc, low, high, start)], pa.array([raw[start:stop]], pa.binary())],
                        ["row", "part", "doc_id", "low", "high", "start", "raw"],
                    )

    return docs.select("row", "doc_id", "text").mapInArrow(cut, "row long, part long, doc_id long, low long, high long, start long, raw binary")


def _write(rows: list[tuple[int, int, int | None, bool, fr.Fragment]]) -> pa.Table:
    parts = [r[4] for r in rows]
    columns = [pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.bool_()) for k in range(4)]
    columns.append(pa.array([p.cut for p in parts], pa.bool_()))
    columns += [pa.array([getattr(p, s) for p in parts], pa.int64()) for s in STATS]
    columns.append(pa.array([p.text for p in parts], pa.binary()))
    columns += [_lists([p.pairs for p in parts]), _lists([p.times for p in parts])]
    columns += [_lists([getattr(getattr(p, name.split("_", 1)[0]), name.split("_", 1)[1]) for p in parts]) for name in OPEN]
    return pa.table(columns, ["row", "part", "doc_id", "fine", "cut", *STATS, "text", "pairs", "times", *OPEN])


def _read(rows: pa.Table) -> list[fr.Fragment]:
    def array(name, i):
        return rows.column(name)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)

    plain = rows.select(["cut", *STATS, "text"]).to_pylist()
    return [
        fr.Fragment(
            **own, pairs=array("pairs", i), times=array("times", i),
            before=fr.Tokens(*[array(name, i) for name in OPEN[:4]]), after=fr.Tokens(*[array(name, i) for name in OPEN[4:]]),
        )
        for i, own in enumerate(plain)
    ]


def range_fragments(parts: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """The fragment of each range: of the tokens of the bytes around it, those that start in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(a, b)
        digits, base = fr.Digits(max(len(both.a_size), len(both.b_size))), len(both.b_size)
        for batch in pieces(batches, "raw", PIECE):
            rows = batch.to_pylist()
            # A lone space is a unit here, unlike an empty text.
            tokens, a_runs, b_runs, fine = both.tokens([units_of(r["raw"][1:].decode()) or [""] for r in rows])
            out = []
            for i, r in enumerate(rows):
                found = tokens.part(slice(a_runs[i], a_runs[i + 1]), slice(b_runs[i], b_runs[i + 1]))
                keep, first = [], []
                for size in (found.a_len, found.b_len):
                    at = r["start"] + np.concatenate([[0], np.cumsum(size)])
                    inside = np.searchsorted(at[:-1], [r["low"], r["high"]])
                    keep.append(slice(*inside.tolist()))
                    first.append(int(at[inside[0]]))
                part = fr.fragment(found.part(*keep), first[0], first[1], digits, base)
                out.append((r["row"], r["part"], r["doc_id"], bool(fine[i]), part))
            yield from _write(out).combine_chunks().to_batches()

    return parts.mapInArrow(run, FRAGMENT)


def aligned_long(docs: DataFrame, a: bytes, b: bytes, with_groups: bool, longest: int) -> DataFrame:
    """The same rows as `aligned_short` for texts of up to `longest` bytes, each a block of its own.

    Ranges are dealt over tasks, and FAN neighbouring fragments at a time become one. Only the groups and pairs
    of a text, which are its result, come together in the end; its bytes and tokens do not.
    """
    size = RANGE
    parts = ranges(docs, size)
    found = range_fragments(parts.repartition("row", "part"), a, b)
    vocabulary = Tokenizers(a, b)
    largest, base = max(len(vocabulary.a_size), len(vocabulary.b_size)), len(vocabulary.b_size)

    def joined(rows: pa.Table) -> tuple[dict, bool, fr.Fragment, fr.Digits]:
        rows, digits = rows.sort_by("part"), fr.Digits(largest)
        # A range that does not keep its bytes has no tokens to compose with, and neither has its text.
        fine = all(rows.column("fine").to_pylist())
        part = fr.compose(_read(rows), digits, base) if fine else fr.Fragment()
        return rows.select(["row", "part", "doc_id"]).slice(0, 1).to_pylist()[0], fine, part, digits

    def climb(rows: pa.Table) -> pa.Table:
        own, fine, part, _ = joined(rows)
        return _write([(own["row"], own["part"] // FAN, own["doc_id"], fine, part)])

    def finish(rows: pa.Table) -> pa.Table:
        own, fine, part, digits = joined(rows)
        done = fr.whole(part, digits, base) if fine else part
        row = _aligned(
            [-1 - own["row"]], [own["doc_id"]], [[getattr(done, s)] for s in STATS],
            [done.text.decode() if with_groups else None], [_digest(done.text)], [done.pairs], [done.times],
        )
        return pa.Table.from_batches([row])

    most = longest // size + 2
    while most > FAN:
        found, most = found.groupBy("row", F.floor(F.col("part") / FAN)).applyInArrow(climb, FRAGMENT), -(-most // FAN)
    return found.groupBy("row").applyInArrow(finish, ALIGNED)


def linked_pairs(aligned: DataFrame) -> DataFrame:
    """block, pair, docs: the distinct pairs of blocks and how many of their texts hold each, from one task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
            pairs = batch.column(1).flatten().to_numpy()
            for block in np.unique(blocks).tolist():
                found, docs = np.unique(pairs[blocks == block], return_counts=True)
                columns = [pa.array(np.full(len(found), block)), pa.array(found), pa.array(docs)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "pair", "docs"])

    each = aligned.select("block", "pairs").mapInArrow(run, "block long, pair long, docs long")
    return each.groupBy("block", "pair").agg(F.sum("docs").alias("docs"))


def alignment(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, if asked for) of every row of docs.

    A encodes a space and the text, B the text. Null and empty texts, and texts whose bytes a tokenizer does not
    give back, have no tokens: zeros and ''. Repeated rows count as documents of their own; other columns are
    ignored. A pair's count is the number of documents that link it anywhere. Pairs travel once per block of
    documents, so one that all documents have is no larger than others.
    """
    a, b = load(a_path, b_path)
    base = Tokenizers(a, b).b.vocab_size()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of().alias("text"))
    size = F.octet_length("text")
    longest = docs.agg(F.max(F.octet_length("text"))).first()[0] or 0
    aligned = aligned_short(rows.filter(size <= RANGE), a, b, with_groups)
    if longest > RANGE:
        aligned = aligned.unionByName(aligned_long(rows.filter(size > RANGE), a, b, with_groups, longest))
    folder = scratch_folder(docs.sparkSession, "aligned")
    aligned.write.option("compression", "zstd").parquet(folder)
    aligned = docs.sparkSession.read.schema(aligned.schema).parquet(folder)

    asked = materialize(linked_pairs(aligned))
    counts = asked.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.floor(F.col("pair") / base))
    # The pairs of one id of A are at most as many as B has ids.
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    known = counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    answers = asked.select("block", "pair").join(known, "pair").select("block", "pair", "n", "best")

    def count(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("pair").to_numpy())
        pairs, n, best = (found.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
        lists = texts.column("pairs").combine_chunks()
        own, times = lists.flatten().to_numpy(), texts.column("times").combine_chunks().flatten().to_numpy()
        at = np.searchsorted(pairs, own) if len(own) else fr.NONE
        doc = np.repeat(np.arange(texts.num_rows), lists.value_lengths().to_numpy())
        sums = [np.zeros(texts.num_rows, np.int64), np.zeros(texts.num_rows, np.int64)]
        np.add.at(sums[0], doc, times * best[at])
        np.add.at(sums[1], doc, times * n[at])
        kept = texts.drop_columns(["block", "pairs", "times"])
        return kept.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, n_best long, count_sum long"
    out = aligned.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(count, schema)
    return out.select("doc_id", *STATS, "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else []))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
