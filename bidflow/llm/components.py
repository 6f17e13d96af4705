"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.operators.sizing import scratch_folder


def components(edges: DataFrame) -> DataFrame:
    """id, label for every id in edges (a, b): the smallest id that can be reached.

    Each round joins every vertex to its smallest neighbour, follows these pointers to their ends, and
    contracts the graph, which at least halves what is left of a component. Tables of a round are written
    to the shared folder; only row counts reach the driver. An empty graph has no rows.
    """
    spark = edges.sparkSession
    folder = scratch_folder(spark, "components")
    step = 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal step
        step += 1
        df.write.parquet(f"{folder}/{step}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{step}")

    def both_ways(pairs: DataFrame) -> DataFrame:
        return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

    left = kept(edges.select("a", "b").filter("a <> b").distinct())
    labels = None
    while not left.isEmpty():
        # The smallest of a vertex and its neighbours; pointers only go down, so they end.
        parent = kept(both_ways(left).groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("up")))
        while True:
            above = parent.select(F.col("id").alias("up"), F.col("up").alias("top"))
            jumped = kept(parent.join(above, "up").select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            parent = jumped.select("id", "up")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select("id", F.col("up").alias("label"))
        else:
            up = parent.select(F.col("id").alias("label"), "up")
            labels = kept(labels.join(up, "label", "left").select("id", F.coalesce("up", "label").alias("label")))
        top = parent.select(F.col("id").alias("a"), F.col("up").alias("ra"))
        end = parent.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        left = kept(
            left.join(top, "a").join(end, "b").filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
    if labels is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return labels
