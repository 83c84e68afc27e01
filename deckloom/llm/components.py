"""Connected components of an edge table by large-star and small-star rounds.

A vertex's least neighbour is found from partial minima, one row a task. Each edge then meets its vertex's minimum in an equi-join whose
other side has one row a vertex: a hot vertex's edges stay narrow rows, which adaptive execution splits over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import hash_bits, restaged, staged


def _least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``m``, the least of u and all its v. Minima are taken before anything meets by key."""
    least = pairs.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", F.least("u", "_m").alias("m"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(h)"), F.expr("sum(h % 1000003)")).first()) if "h" in edges.columns else ()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node. Self loops count as nodes."""
    nodes_alone = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    current = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        small = _least(down)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        current = restaged(small, current)
        now = _mark(current.withColumn("h", hash_bits(F.col("a"), F.col("b"))))
        if now == before:
            break
        before = now
    found = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    alone = nodes_alone.join(found.union(roots), "node", "left_anti").withColumn("component", F.col("node"))
    return found.union(roots).union(alone)
