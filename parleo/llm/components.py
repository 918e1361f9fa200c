"""Connected components by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleo.llm.common import shared_table


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them.

    ``both_ways``: large star (larger neighbours of any node); otherwise small
    star (a node and its smaller neighbours).  Only minima are aggregated, no
    neighbourhood is ever collected.
    """
    at = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else edges
    least = at.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    hung = at.join(least, "a")
    if both_ways:
        out = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge list (a, b)."""
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, seen = shared_table(e), None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(mark):
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = tuple(mark)
        e = shared_table(_star(_star(e, True), False))
