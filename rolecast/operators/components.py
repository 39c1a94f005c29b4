"""Connected components over shared keys, at any group size (GR-01, GR-08).

Edges are stars: each row that carries a key is linked to the smallest id with
that key, so a key held by n rows costs n edges and never n² pairs.  The stars
are then rewired by alternating large-star and small-star steps (Kiveris et
al., "Connected Components in MapReduce and Beyond", 2014), which need a
number of rounds logarithmic in the longest chain.  Every step is a grouped
minimum, which combines map-side, and an equi join, which adaptive execution
splits when one key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.operators.shaping import cut_lineage


def star_edges(members: DataFrame, node: str, key: str) -> DataFrame:
    """(u, v) with u > v: each member of a shared key and the key's smallest member."""
    # Keys often begin alike, so that a sort has to compare them whole; a hash in front tells most apart at once.
    # Counting hashes needs no sort and leaves out the keys that one row holds, which are most of them.
    pairs = members.select(F.col(node).alias("u"), F.col(key).alias("k")).filter(
        F.col("u").isNotNull() & F.col("k").isNotNull()).withColumn("h", F.xxhash64("k"))
    shared = pairs.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    pairs = pairs.join(shared, "h", "left_semi")
    centers = pairs.groupBy("h", "k").agg(F.min("u").alias("v"), F.max("u").alias("last")).filter("v <> last").drop("last")
    return pairs.join(centers, ["h", "k"]).filter("u <> v").select("u", "v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Every node points at one center, and no center points anywhere."""
    if not edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return False
    centers = edges.select(F.col("v").alias("u")).distinct()
    return edges.join(centers, "u", "left_semi").isEmpty()


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest id of the component, for every node with an edge.

    Nodes without an edge are their own component and are not listed.
    """
    current = cut_lineage(edges, "edges")
    # Every round shortens the longest chain, so this ends.
    while not _settled(current):
        current = cut_lineage(_small_star(_large_star(current)), "edges")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        roots.select("node", F.col("node").alias("label")))
