"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.llm.common import work_dir, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); component is the smallest node.

    Each round hooks the larger neighbours of every node to its smallest neighbour, then the smaller
    ones. Every link goes along the least neighbour of its end, found by an aggregation that combines
    in each task, so a node with very many links is met by joins only, which adaptive execution can
    split. Each round is written to the shared folder; the driver sees a count and a sum. Links of a
    node to itself keep the node; null ends are dropped; without links the result is empty.
    """
    spark = links.sparkSession
    work = work_dir(spark, "components")
    pairs = links.filter("a IS NOT NULL AND b IS NOT NULL")
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{work}/0")
    seen, step = _state(edges), 0
    while True:
        step += 1
        edges = written(_small_star(_large_star(edges)), f"{work}/{step}")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked to the node's least neighbour, itself included."""
    both = edges.union(edges.select("v", "u")).toDF("n", "x")
    least = both.groupBy("n").agg(F.least(F.min("x"), F.col("n")).alias("m"))
    hooked = both.filter("x > n").join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v"))
    return hooked.union(edges.filter("u = v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are linked to the least of these."""
    below = edges.filter("u > v")
    least = below.groupBy("u").agg(F.min("v").alias("m"))
    hooked = below.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.union(least.select("u", "m")).union(edges.filter("u = v")).distinct()
