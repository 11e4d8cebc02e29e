"""Connected components of a graph given as links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedrank.session import release, stored, stored_since


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component): for each node of `links` (a, b) the smallest node that it reaches.

    Rounds of two steps. First each node hands the least neighbour it has to its larger neighbours,
    then to its smaller ones; links turn into stars around the least node of each component after
    a number of rounds that grows with the logarithm of its size. Every step is one aggregation
    with partial sums and one join on the node, so a node with very many links is no group that a
    task has to hold. Each round is written to the shared folder; the round before is then deleted.
    """
    mark = len(stored_since(0))
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small"))
    edges = stored(ends.distinct(), "links")
    known = _signature(edges)
    while True:
        before, last = stored_since(mark), known
        edges = stored(_small_star(_large_star(edges)), "links")
        known = _signature(edges)
        release(links.sparkSession, before)
        if known == last:
            break
    roots = edges.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct()
    return edges.select(F.col("big").alias("node"), F.col("small").alias("component")).unionByName(roots)


def _signature(edges: DataFrame) -> tuple:
    """Equal for equal sets of links; one row whatever their number."""
    mixed = F.xxhash64("big", "small")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.bit_xor(F.xxhash64(mixed, F.lit(1)))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select(F.col("big").alias("u"), F.col("small").alias("v")).unionByName(
        edges.select(F.col("small").alias("u"), F.col("big").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least, "u").where("v <> m")
        .select(F.col("v").alias("big"), F.col("m").alias("small")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("big").agg(F.min("small").alias("m"))
    moved = edges.join(least, "big").where("small <> m").select(F.col("small").alias("big"), F.col("m").alias("small"))
    return moved.unionByName(least.select("big", F.col("m").alias("small"))).distinct()
