"""Operator 8, MinHash near-dedup as a chosen-path set similarity join.

Texts with equal shingle sets are one class. In each of several independent trees, classes branch by a few
minwise tokens chosen by the node they are in. Nodes with few members are compared exhaustively; larger
ones branch again unless most members resemble the first one, since no token divides near copies.
Comparisons use short sketches; each link is confirmed on full shingle sets.

Only components are wanted, so pairs that are already connected need no comparison: the first round
links each class to the most similar one before it, and the second compares what is still apart in a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidflow.llm.components import components
from bidflow.llm.shared import bytes_of, join_groups, lower_ascii, mixed, pieces, shingle_hashes, table, text_of
from bidflow.operators.sizing import scratch_folder

WIDTH = 5
#: Minwise tokens per class.
TOKENS = 64
#: A pair with 85% in common agrees in a token with that chance. Two tokens per node and four trees miss
#: it with 0.15 ** 8 when nodes are small; after three more levels with (1 - 0.9775 ** 4) ** 4, under 0.0001.
TREES, BRANCHES, LEVELS = 4, 2, 4
#: Members up to which a node is compared exhaustively, and members of one block of a node that stays large.
SMALL, BLOCK = 200, 1000
#: Sets of small documents that one block may hold even if they are more than `BLOCK`.
BLOCK_BYTES = 4 << 20
#: Standard deviations below its expectation at which the sketch of a pair is still taken for a candidate. Trees share
#: the tokens, so what this loses (of pairs with exactly 85% in common 1.5e-7, with 80% 2e-8) no tree brings back.
SLACK = 6.0
PIECE = 1 << 20


def minwise_factors() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:TOKENS] | np.uint64(1), seeds[TOKENS:]


def minwise(hashes: np.ndarray) -> np.ndarray:
    """For each of `TOKENS` random orders the smallest value of a set of hashes."""
    a, b = minwise_factors()
    out = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        values = a[:, None] * (part ^ (part >> np.uint64(29)))[None, :]
        values ^= b[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def shingle_sets(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending; A-Z count as a-z."""
    data, bounds = bytes_of(batch.column(column))
    hashes, where, _ = shingle_hashes(lower_ascii(data), bounds, WIDTH)
    return [np.unique(hashes[a:b]) for a, b in zip(where[:-1], where[1:])]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null when empty), tokens (the low half of each, in one binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            sets = shingle_sets(batch, 1)
            tokens = [minwise(s).astype("<u4").tobytes() if len(s) else None for s in sets]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.binary())],
                ["doc_id", "n_shingles", "digest", "tokens"],
            )

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, tokens binary")


def child(path, branch):
    """The node below a node for one branch: its token is chosen by the node, its value by the class."""
    token = F.pmod(F.xxhash64(path, branch), F.lit(TOKENS)).cast("int")
    return F.xxhash64(path, branch, F.substring("tokens", 4 * token + 1, F.lit(4)))


@F.pandas_udf(T.BooleanType())
def resembles(tokens: pd.Series, other: pd.Series) -> pd.Series:
    """Whether at least half of the tokens are equal."""
    a = np.frombuffer(b"".join(tokens), "<u4").reshape(-1, TOKENS)
    b = np.frombuffer(b"".join(other), "<u4").reshape(-1, TOKENS)
    return pd.Series(2 * (a == b).sum(axis=1) >= TOKENS)


def nodes(classes: DataFrame, kept) -> DataFrame:
    """path, rep, members: every node with at least two members where branching ended, with all of them."""

    def branched(rows: DataFrame) -> DataFrame:
        branch = F.explode(F.array(*[F.lit(b) for b in range(BRANCHES)]))
        below = rows.select("rep", "tokens", "path", branch.alias("branch")).select("rep", child(F.col("path"), F.col("branch")).alias("path"))
        below = below.distinct()
        sizes = below.groupBy("path").agg(F.count("*").alias("members")).filter("members > 1")
        return kept(below.join(sizes, "path"))

    root = F.explode(F.array(*[F.xxhash64(F.lit(f"tree {t}")) for t in range(TREES)]))
    level = branched(classes.select("rep", "tokens", root.alias("path")))
    ended = []
    for _ in range(LEVELS - 1):
        ended.append(level.filter(F.col("members") <= SMALL))
        large = level.filter(F.col("members") > SMALL)
        if large.isEmpty():
            break
        # Near copies stay together whatever the token: such a node ends here.
        tokens = classes.select("rep", "tokens")
        large = kept(large.join(tokens, "rep"))
        heads = large.groupBy("path").agg(F.min("rep").alias("rep")).join(tokens, "rep").select("path", F.col("tokens").alias("head"))
        alike = large.join(heads, "path").groupBy("path").agg(F.avg(resembles("tokens", "head").cast("int")).alias("share"))
        alike = kept(alike.withColumn("dense", F.col("share") >= 0.5).drop("share"))
        ended.append(large.join(alike.filter("dense"), "path", "left_semi").select(level.columns))
        mixed_nodes = large.join(alike.filter("NOT dense"), "path", "left_semi")
        if mixed_nodes.isEmpty():
            break
        level = branched(mixed_nodes)
    else:
        ended.append(level)
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return out


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows of sorted batches by equal values of the first columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and (a > 0 or first != last):
                yield held
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield held


@dataclass
class Block:
    """Rows of one block of a node: class, component so far, whether it visits, whether it also does elsewhere (it is
    loose in the node), set size and sketch."""

    rows: pa.Table
    rep: np.ndarray
    label: np.ndarray
    visitor: np.ndarray
    loose: np.ndarray
    size: np.ndarray
    sketch: np.ndarray


def block_of(group: list[pa.RecordBatch]) -> Block:
    rows = pa.Table.from_batches(group).combine_chunks()
    raw = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), "<u4").reshape(-1, TOKENS)
    return Block(rows, *(rows.column(c).to_numpy() for c in ("rep", "label", "visitor", "loose", "n_shingles")), raw)


def passes(block: Block, others, one: int, percent: int) -> np.ndarray:
    """Numbers of tokens that rows share with one row, and -1 where the pair cannot reach the similarity."""
    share = percent / 100
    least = TOKENS * share - SLACK * (TOKENS * share * (1 - share)) ** 0.5
    equal = (block.sketch[others] == block.sketch[one]).sum(axis=1)
    sizes, size = block.size[others], block.size[one]
    fits = (equal >= least) & (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size))
    return np.where(fits, equal, -1)


def first_links(percent: int):
    """Each member with the most similar of the members before it in its block, if any is similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for group in by_group(batches, 2):
            block = block_of(group)
            for i in range(1, len(block.rep)):
                equal = passes(block, slice(0, i), i, percent)
                best = int(equal.argmax())
                if equal[best] >= 0 and block.rep[best] != block.rep[i]:
                    out.append((block.rep[best], block.rep[i], equal[best]))
        columns = np.array(out, np.int64).reshape(-1, 3).T
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "equal"])

    return run


def apart(block: Block, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each visitor of a block with the hosts that are similar by sketch and in another component.

    Two loose classes visit each other's blocks, so the one with the smaller id waits for the other.
    """
    hosts = np.flatnonzero(~block.visitor)
    if not len(hosts):
        return
    sketch, rep, label, loose, size = (v[hosts] for v in (block.sketch, block.rep, block.label, block.loose, block.size))
    share = percent / 100
    least = TOKENS * share - SLACK * (TOKENS * share * (1 - share)) ** 0.5
    for i in np.flatnonzero(block.visitor):
        own = block.size[i]
        fits = (label != block.label[i]) & (~loose | (rep < block.rep[i]))
        fits &= 100 * np.minimum(size, own) >= percent * np.maximum(size, own)
        some = np.flatnonzero(fits)
        if len(some):
            some = some[(sketch[some] == block.sketch[i]).sum(axis=1, dtype=np.uint8) >= least]
        if len(some):
            yield i, hosts[some]


#: Places of the table in which `Sets` counts, a power of two, and values it takes up at a time.
PLACES, STEP = 1 << 20, 1 << 17


class Sets:
    """Full sets of the rows of a block, counted against one of them in bulk."""

    def __init__(self, column: pa.ListArray):
        self.bounds = np.array(column.offsets, np.int64)
        self.values = np.array(column.values)
        self.marks = np.zeros(PLACES, bool)

    def of(self, row: int) -> np.ndarray:
        return self.values[self.bounds[row] : self.bounds[row + 1]]

    def similar(self, row: int, others: np.ndarray, percent: int) -> list[int]:
        """Those of other rows with 100 * intersection >= percent * union. Values that share a place can only
        make the first count too large, and what passes it is counted by value."""
        own = self.of(row)
        size = self.bounds[others + 1] - self.bounds[others]
        most = np.empty(len(others), np.int64)
        mine = own & (PLACES - 1)
        self.marks[mine] = True
        ends = np.cumsum(size)
        start = 0
        while start < len(others):
            # A bounded number of values at a time, one set at least.
            done = ends[start] - size[start]
            stop = max(start + 1, int(np.searchsorted(ends, done + STEP, side="right")))
            part = size[start:stop]
            first = ends[start:stop] - part - done
            at = np.arange(part.sum()) + np.repeat(self.bounds[others[start:stop]] - first, part)
            most[start:stop] = np.add.reduceat(self.marks[self.values[at] & (PLACES - 1)], first, dtype=np.int64)
            start = stop
        self.marks[mine] = False
        out = []
        for j in others[100 * most >= percent * (len(own) + size - most)].tolist():
            other = self.of(j)
            both = len(np.intersect1d(own, other, assume_unique=True))
            if 100 * both >= percent * (len(own) + len(other) - both):
                out.append(j)
        return out


def still_apart(percent: int):
    """The rows of a block that `apart` pairs with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, 2):
            block = block_of(group)
            marked = np.zeros(len(block.rep), bool)
            for i, found in apart(block, percent):
                marked[i] = True
                marked[found] = True
            if marked.any():
                yield from block.rows.filter(pa.array(marked)).to_batches()

    return run


def confirmed_links(percent: int):
    """Links between rows of a block by their full sets. A pair that meets in several nodes is left to the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in by_group(batches, 2):
            block = block_of(group)
            path = block.rows.column("path")[0].as_py()
            sets = Sets(block.rows.column("shingles").combine_chunks())
            earlier = [{p for p in paths if p < path} for paths in block.rows.column("paths").to_pylist()]
            up = {label: label for label in block.label.tolist()}

            def top(label: int) -> int:
                while up[label] != label:
                    up[label] = up[up[label]]
                    label = up[label]
                return label

            for i, found in apart(block, percent):
                for j in sets.similar(i, found, percent):
                    a, b = top(block.label[i].item()), top(block.label[j].item())
                    if a == b or not earlier[i].isdisjoint(earlier[j]):
                        continue
                    up[max(a, b)] = min(a, b)
                    out.append((min(block.rep[i], block.rep[j]), max(block.rep[i], block.rep[j])))
        columns = np.array(out, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b"])

    return run


#: Bits of the filter in `prefiltered`.
FILTER_BITS = 26


def prefiltered(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id may be among ids: spares most of the others a shuffle, and needs a join after it.

    The filter has a fixed size of 8 MB; with more ids than it can tell apart it lets more rows through.
    """
    place = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << FILTER_BITS))
    words = ids.select(place.alias("at")).select(F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 AS int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    filled = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    filled[found.column("word").to_numpy()] = found.column("bits").to_numpy()

    @F.pandas_udf(T.BooleanType())
    def possible(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((filled[at >> 6] >> (at & 63)) & 1 == 1)

    return docs.filter(possible(place))


def near_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Linked are documents whose sets of 5-word shingles (A-Z as a-z; fewer words: the whole sequence) have
    100 * intersection >= percent * union. Documents without words, null texts among them, link with
    nothing. component_id is the smallest doc_id of a document's component. Rows that share a doc_id are one
    document. Rows without a doc_id get the component of their equals that have one, else null.
    """
    spark = docs.sparkSession
    folder = scratch_folder(spark, "near")
    step = 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal step
        step += 1
        df.write.parquet(f"{folder}/{step}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{step}")

    rows = kept(described(docs))
    groups = kept(rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    classes = kept(
        rows.select(F.col("doc_id").alias("rep"), "digest", "n_shingles", "tokens")
        .join(groups.select("rep", "digest"), ["rep", "digest"]).dropDuplicates(["digest"]).drop("digest")
    )

    tree = kept(nodes(classes, kept))
    members = tree.join(classes, "rep")
    # Blocks of a node that stayed large: each also gets the node's first member, which ties them together.
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    large = tree.filter(F.col("members") > BLOCK)
    heads = large.groupBy("path", "members").agg(F.min("rep").alias("rep")).join(classes, "rep")
    heads = heads.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    columns = ["path", "block", "rep", "label", "visitor", "loose", "n_shingles", "tokens"]
    bare = members.withColumn("block", block).unionByName(heads)
    bare = bare.withColumn("label", F.lit(0).cast("long")).withColumn("visitor", F.lit(False)).withColumn("loose", F.lit(False))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("path", "block").sortWithinPartitions("path", "block", "rep")

    # Round one: a class goes with the most similar of those before it, over all its nodes.
    found = dealt(bare.select(columns)).mapInArrow(first_links(percent), "a long, b long, equal long")
    best = F.max(F.struct("equal", (-F.col("a")).alias("a")))
    pairs = kept(found.groupBy("b").agg(best.alias("best")).select((-F.col("best.a")).alias("a"), "b"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            made = shingle_sets(batch, 1)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in made])])
            flat = np.concatenate(made).view(np.int64) if made else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "shingles"]
            )

    def sets(ids: DataFrame) -> DataFrame:
        """Full shingle sets of some classes. Rows that share a doc_id count as one document."""
        texts = prefiltered(docs.select("doc_id", text_of().alias("text")), ids).join(ids, "doc_id")
        return kept(texts.mapInArrow(sets_of, "id long, shingles array<long>"))

    whole = sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    both = F.size(F.array_intersect("sa", "sb"))
    links = kept(
        pairs.join(whole.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        .join(whole.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").withColumn("both", both)
        .filter(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")
    )
    first = components(links)

    # Round two: what is not in the component of a node's first member is loose and visits all members of the node.
    # Members are dealt to blocks of hosts, loose ones to blocks of visitors, and each pair of blocks is one group.
    labelled = kept(tree.join(first.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    main = labelled.groupBy("path").agg(F.min("rep").alias("head"), F.min("label").alias("low"), F.max("label").alias("high"))
    main = main.filter("low <> high").select("path", "head").join(
        labelled.select("path", F.col("rep").alias("head"), F.col("label").alias("main")), ["path", "head"]
    )
    split = kept(labelled.join(main.select("path", "main"), "path").join(classes, "rep").withColumn("loose", F.col("label") != F.col("main")))
    weight = 8 * F.col("n_shingles") + 4 * TOKENS

    def cut(rows, size):
        """Blocks of `BLOCK` rows, or fewer ones of `BLOCK_BYTES` where sets are small."""
        return F.greatest(F.lit(1), F.least(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BYTES))).cast("long")

    widths = split.groupBy("path").agg(
        cut(F.count("*"), F.sum(weight)).alias("wide"), cut(F.count_if("loose"), F.sum(F.when(F.col("loose"), weight))).alias("high")
    )
    split = split.join(widths, "path")
    x, y = F.pmod(F.xxhash64("rep"), F.col("wide")), F.pmod(F.xxhash64("rep", F.lit("visitor")), F.col("high"))
    every_x, every_y = (F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)) for n in ("wide", "high"))
    visitors = split.filter("loose").withColumn("visitor", F.lit(True)).withColumn("x", every_x).withColumn("block", F.col("x") * F.col("high") + y)
    hosts = split.withColumn("visitor", F.lit(False)).withColumn("y", every_y).withColumn("block", x * F.col("high") + F.col("y"))
    schema = "path long, block long, rep long, label long, visitor boolean, loose boolean, n_shingles long, tokens binary"
    open_ = kept(dealt(hosts.select(columns).unionByName(visitors.select(columns))).mapInArrow(still_apart(percent), schema))
    reps = open_.select("rep").distinct()
    # A class is in at most TREES * BRANCHES ** LEVELS nodes.
    paths = tree.join(reps, "rep", "left_semi").groupBy("rep").agg(F.collect_set("path").alias("paths"))
    own = paths.join(sets(reps.withColumnRenamed("rep", "doc_id")).withColumnRenamed("id", "rep"), "rep")
    more = kept(dealt(open_.join(own, "rep").select(*columns, "paths", "shingles")).mapInArrow(confirmed_links(percent), "a long, b long").distinct())
    labels = components(links.union(more))

    named = groups.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", "n", F.coalesce("label", "rep").alias("component_id"))
    linked = join_groups(rows.select("doc_id", "n_shingles", "digest").filter("digest IS NOT NULL"), named, "digest", "n", rows.count())
    alone = rows.filter("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return linked.select(columns).union(alone.select(columns)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
