"""Operator 13, spelling variants grouped by edit distance one through pivotal grams.

Bigrams are ranked from rare to frequent over all words. A word's gram prefix is its rarest bigrams; its
pivots are two disjoint bigrams of the prefix with the smallest total frequency, chosen by dynamic
programming. One edit breaks at most one pivot, so of two near words the one whose prefix ends earlier has a
pivot that stands in the other's prefix, and all letters on one side of it are the same in both words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm.shared import table, text_of
from bidflow.operators.sizing import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "([a-z\\u00C0-\\u00FF]+)"
GRAM = 2
#: Gram occurrences in a prefix: one edit changes at most GRAM of them, so one of GRAM + 1 is left.
PREFIX = GRAM + 1


def observed_words(docs: DataFrame, noise: int = 31) -> DataFrame:
    """word, n: runs of letters of whole texts in lower case (A to Z only) with their number of occurrences.

    A run whose hash with its document's id is a multiple of `noise` loses the code point the hash names
    (0: none does). Null texts have no runs, a null id counts as empty, repeated rows count again. Counts are
    combined per task before the shuffle, so a frequent word is one row per task.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(text_of(), UPPER, LOWER), F.lit(RUNS), F.lit(1))).alias("run"),
    )
    if not noise:
        return runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, int]]:
    """(rank, frequency) of each bigram, from rare to frequent, ties by the bigram.

    There are at most as many bigrams as pairs of letters, about 8,000 for the letters of `RUNS`, whatever the
    number of words; that is all the driver gets and tasks are sent.
    """
    at = F.sequence(F.lit(1), F.length("word") - GRAM + 1)
    grams = words.filter(F.length("word") >= GRAM).select(F.explode(F.transform(at, lambda i: F.col("word").substr(i, F.lit(GRAM)))).alias("gram"))
    rows = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.gram: (rank, r.n) for rank, r in enumerate(sorted(rows, key=lambda r: (r.n, r.gram)))}


def pivots(places: list[int], cost: dict[int, int], count: int = 2) -> list[int]:
    """Disjoint bigrams among ascending places with the smallest total cost, by dynamic programming.

    best[k] holds, for the places seen so far, the cheapest way to take k of them.
    """
    best: list[list[tuple[int, list[int]]]] = [[(0, [])] + [(1 << 62, [])] * count]
    for i, place in enumerate(places):
        free = sum(p + GRAM <= place for p in places[:i])
        row = list(best[i])
        for k in range(1, count + 1):
            taken = (best[free][k - 1][0] + cost[place], best[free][k - 1][1] + [place])
            row[k] = min(row[k], taken)
        best.append(row)
    return best[-1][count][1]


def signed(words: DataFrame) -> DataFrame:
    """word, n, last (rank that ends the gram prefix), places (of all bigrams up to it), p1, p2 (the pivots).

    Bigrams of the last one's rank all belong to the prefix, so equal bigrams are never split. Words are of
    at least four letters, so two disjoint bigrams exist in a prefix.
    """
    ranks = gram_ranks(words)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, places, first, second = [], [], [], []
            for word in batch.column(0).to_pylist():
                of = [ranks[word[i : i + GRAM]] for i in range(len(word) - GRAM + 1)]
                end = sorted(rank for rank, _ in of)[PREFIX - 1]
                prefix = [i for i, (rank, _) in enumerate(of) if rank <= end]
                p1, p2 = pivots(prefix, {i: of[i][1] for i in prefix})
                last.append(end)
                places.append(prefix)
                first.append(p1)
                second.append(p2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(last, pa.int32()), pa.array(places, pa.list_(pa.int32())),
                    pa.array(first, pa.int32()), pa.array(second, pa.int32()),
                ],
                ["word", "n", "last", "places", "p1", "p2"],
            )

    return words.select("word", "n").mapInArrow(sign, "word string, n long, last int, places array<int>, p1 int, p2 int")


def _left(word: Column, n: Column) -> Column:
    return word.substr(F.lit(1), n)


def _right(word: Column, n: Column) -> Column:
    return word.substr(F.length(word) - n + 1, n)


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


# The letters outside the side that a pivot keeps are halved once more, since one edit leaves one half whole
# too. A key names the pivot by its place from the kept end, and holds the kept side and the kept half:
#   0: all up to the pivot, and the half next to it   1: all up to the pivot, and the far half
#   2: the pivot to the end, and the half next to it  3: the pivot to the end, and the far half


def index_keys(word: Column, place: Column) -> Column:
    """The four keys of a word for a bigram of its prefix."""
    size, rest = F.length(word), F.length(word) - place - GRAM
    near = _half(rest)
    far = _half(place)
    return F.array(
        F.concat_ws(":", F.lit("0"), place, _left(word, place + GRAM + near)),
        F.concat_ws(":", F.lit("1"), place, _left(word, place + GRAM), _right(word, rest - near)),
        F.concat_ws(":", F.lit("2"), size - place, _right(word, size - far)),
        F.concat_ws(":", F.lit("3"), size - place, _left(word, far), _right(word, size - place)),
    )


def pivot_keys(word: Column, p1: Column, p2: Column) -> Column:
    """Keys under which near words of one letter less, as many and one more have this word's pivots."""
    size = F.length(word)
    found = []
    for other in (size - 1, size, size + 1):
        rest, before = other - p1 - GRAM, other - size + p2
        near, far = _half(rest), _half(before)
        found += [
            F.when(rest >= 0, F.concat_ws(":", F.lit("0"), p1, _left(word, p1 + GRAM + near))),
            # A kept half that would reach into the kept side cannot be whole in both words.
            F.when((rest >= 0) & (rest - near <= size - p1 - GRAM), F.concat_ws(":", F.lit("1"), p1, _left(word, p1 + GRAM), _right(word, rest - near))),
            F.when(other - far <= size, F.concat_ws(":", F.lit("2"), size - p2, _right(word, other - far))),
            F.concat_ws(":", F.lit("3"), size - p2, _left(word, far), _right(word, size - p2)),
        ]
    return F.array_distinct(F.array_compact(F.array(*found)))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of words that differ by one inserted, deleted or replaced code point, once.

    words (word, n) are distinct and of at least four letters. Letters that a pivot keeps are part of the
    join key, so positions agree by construction and a key's words differ in about half of what is left.
    Keys that a pair has in common besides its first are recognised from the two words, not by a distinct.
    """
    own = materialize(signed(words))
    word, place = F.col("word"), F.col("place")
    index = own.select(word.alias("b"), F.col("n").alias("n_b"), F.col("last").alias("last_b"), F.explode("places").alias("place")).select(
        "b", "n_b", "last_b", F.explode(index_keys(F.col("b"), place)).alias("key")
    )
    probe = own.select(
        word.alias("a"), F.col("n").alias("n_a"), F.col("last").alias("last_a"), "p1", "p2",
        F.explode(pivot_keys(word, F.col("p1"), F.col("p2"))).alias("key"),
    )
    a, b, p1, p2 = (F.col(c) for c in ("a", "b", "p1", "p2"))
    kind = F.left("key", F.lit(1))
    start = p1 + GRAM
    through = start + _half(F.length(b) - start)
    back = F.length(b) - _half(F.length(b) - F.length(a) + p2)
    kept_start = _left(a, start) == _left(b, start)
    first = (
        F.when(kind == "0", F.lit(True))
        .when(kind == "1", _left(a, through) != _left(b, through))
        .when(kind == "2", ~kept_start)
        .otherwise(~kept_start & ((back > F.length(a)) | (_right(a, back) != _right(b, back))))
    )
    # Which of the two words asks: the one whose prefix ends earlier. Its pivot is rare enough for the other's prefix.
    asks = (F.col("last_a") < F.col("last_b")) | ((F.col("last_a") == F.col("last_b")) & (a < b))
    return probe.join(index, "key").filter(asks & first & (F.levenshtein(a, b, 1) == 1)).select("a", "n_a", "b", "n_b")


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, n, form, form_n, root, n_near of distinct words (word, n) of at least four letters.

    form is the near word with the largest n (ties: the smallest in code-point order) if that is at least
    `factor` times the word's own, else null; root follows forms to the last. No word has more near words
    than there are letters to change it with, so no group grows with the corpus. An empty table has no rows.
    """
    words = materialize(words.select("word", "n"))
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(*[
        F.struct(F.col(x).alias("word"), F.col(f"n_{x}").alias("n"), F.col(y).alias("near"), F.col(f"n_{y}").alias("near_n"))
        for x, y in (("a", "b"), ("b", "a"))
    ])).alias("e")).select("e.*")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("word"))).alias("best")
    linked = materialize(both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best))
    frequent = -F.col("best.minus") >= factor * F.col("n")
    formed = linked.filter(frequent).select("word", F.col("best.word").alias("up"))
    # Each step along forms multiplies n by the factor, which bounds the steps; each join doubles their length.
    most = words.agg(F.max("n")).first()[0] or 1
    steps, reach = 0, most
    while reach >= factor:
        steps, reach = steps + 1, reach // factor
    ups = formed
    for _ in range(max(0, steps - 1).bit_length()):
        ups = materialize(ups)
        above = ups.select(F.col("word").alias("up"), F.col("up").alias("top"))
        ups = ups.join(above, "up", "left").select("word", F.coalesce("top", "up").alias("up"))
    found = words.join(linked.drop("n"), "word", "left").join(ups, "word", "left")
    form = F.when(frequent, F.col("best.word"))
    return found.select(
        "word", "n", form.alias("form"), F.when(frequent, -F.col("best.minus")).alias("form_n"),
        F.coalesce("up", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observed_words(table(spark, sf_dir, "documents"))
    return variants(seen.filter((F.col("n") >= 2) & (F.length("word") >= 7)))


#: The check sums of the hash are computed from their polynomial, since DuckDB has no function for them.
ORACLE_OP13 = r"""
WITH RECURSIVE
bytes AS (SELECT range AS b, range::BIGINT AS c, 0 AS i FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bytes WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bytes WHERE i = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY id, run),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(id || ':' || run)), lambda i: ('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h FROM counted, crc),
noted AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM noted WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
-- Of two near words one arises from the other by a change at one place; without that place both are the same.
holes AS (SELECT word, n, p, substr(word, 1, p) AS a, substr(word, p + 2) AS b FROM words, unnest(range(0, length(word))) AS u(p)),
near AS (SELECT DISTINCT word, n, near, near_n FROM (
    SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.p = y.p AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION ALL SELECT x.word, x.n, y.word, y.n FROM holes x JOIN words y ON x.a || x.b = y.word
    UNION ALL SELECT y.word, y.n, x.word, x.n FROM holes x JOIN words y ON x.a || x.b = y.word)),
linked AS (SELECT word, n, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word, n),
formed AS (SELECT l.word, l.n_near, l.top, min(near) AS form FROM linked l JOIN near m ON m.word = l.word AND m.near_n = l.top GROUP BY l.word, l.n_near, l.top),
forms AS (SELECT w.word, w.n, CASE WHEN top >= 10 * n THEN form END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n, coalesce(n_near, 0) AS n_near
  FROM words w LEFT JOIN formed USING (word)),
up AS (SELECT word, word AS root FROM forms UNION ALL SELECT up.word, f.form FROM up JOIN forms f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.form, f.form_n, u.root, f.n_near FROM forms f JOIN (
  SELECT up.word, up.root FROM up JOIN forms g ON g.word = up.root WHERE g.form IS NULL) u ON u.word = f.word
"""
