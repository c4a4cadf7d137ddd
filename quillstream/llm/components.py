"""Connected components of an edge list by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before its shuffle) and a join; edges only ever move to smaller
ids, and the number of rounds grows with the logarithm of the size of a component, not with its diameter.
Each round's edges are a table in the shared folder, so a lost executor repeats one round at most. A hub's
neighbours are spread: the table of least neighbours is counted, and broadcast up to BROADCAST_ROWS; beyond that it
is joined by a shuffle whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import drop, materialize

#: Rows of two longs: 3 MB or so.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _edges(df: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller node, each once, without loops."""
    return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Join each node's neighbours to the least of them and itself. both: large star (from each node, only
    its larger neighbours move); else small star (from each node, its smaller neighbours)."""
    spark = edges.sparkSession
    if both:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, path = materialize(seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "star")
        moved = edges.select(F.col("b").alias("node"), F.col("a").alias("other")).join(small(least).withColumnRenamed("a", "node"), "node").select(F.col("other").alias("a"), F.col("m").alias("b"))
    else:
        least, path = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "star")
        near = edges.withColumnRenamed("a", "node").join(small(least).withColumnRenamed("a", "node"), "node")
        moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out, held = materialize(_edges(moved), "edges")
    drop(spark, path)
    return out, held


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b (longs). Returns node, component (the least node of its component), for each
    node that has an edge to another."""
    spark = edges.sparkSession
    now, path = materialize(_edges(edges), "edges")
    state = None
    while True:
        large, p1 = _star(now, True)
        drop(spark, path)
        small, p2 = _star(large, False)
        drop(spark, p1)
        now, path = small, p2
        after = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(after) == state or after[0] == 0:
            break
        state = tuple(after)
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
