"""Entities kept between runs: new postings join stored ones by their keys (GR-01, GR-06).

Three stored tables, each in parts: which posting stands for a key, which label a posting
got when it came, and what a label gave way to.  A day's postings read the parts that hold
their keys, the parts of the postings these keys stand for, and the parts of the labels
met; the components among these labels alone are computed.  A label that gives way is one
row, so an entity of any size joins another without its postings being touched.  Labels
are the smallest id of their entity, as a run over everything gives them.

Every step only adds what follows from its input, so a run that died half way is run again
with the same postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolecast.config import DEFAULT_KEYWORDS, DEFAULT_PARITY
from rolecast.operators.components import component_labels
from rolecast.operators.resolve import identity_members
from rolecast.operators.shaping import cut_lineage
from rolecast.operators.versioned import PartTable


def _pairs(a: str, b: str) -> StructType:
    return StructType().add(a, "string").add(b, "string")


class EntityIndex:
    """The stored tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.centers = PartTable(spark, f"{path}/centers", _pairs("key", "center"), ["key"], parts)
        self.labels = PartTable(spark, f"{path}/labels", _pairs("node", "label"), ["node"], parts)
        self.roots = PartTable(spark, f"{path}/roots", _pairs("label", "root"), ["label"], parts)

    def _rooted(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with each label replaced by the one it has given way to, however many steps that takes."""
        settled = None
        while True:
            ahead = self.roots.near(df.select(F.col(column).alias("label"))).select(F.col("label").alias("_l"), F.col("root").alias("_r"))
            step = cut_lineage(df.join(ahead, F.col(column) == F.col("_l"), "left").withColumn("_moved", F.col("_r").isNotNull()).withColumn(
                column, F.coalesce("_r", column)).drop("_l", "_r"), "rooted")
            still, moved = step.filter("NOT _moved").drop("_moved"), step.filter("_moved").drop("_moved")
            settled = still if settled is None else settled.unionByName(still)
            if moved.isEmpty():
                return settled
            # Only what has moved may have to move on.
            df = moved

    def add(self, postings: DataFrame, kw=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY) -> DataFrame:
        """Takes postings in; returns (label, root): the labels of stored entities that gave way, and to which."""
        members = cut_lineage(identity_members(postings.filter("id_externo IS NOT NULL"), kw, parity), "members")
        firsts = cut_lineage(members.filter("key IS NOT NULL").groupBy(F.xxhash64("key").alias("_h"), "key").agg(
            F.min("node").alias("center")).drop("_h"), "firsts")
        self.centers.merge(firsts, lambda stored, new: stored.unionByName(new.join(stored.select("key"), "key", "left_anti").select("key", "center")))
        centers = self.centers.near(firsts).select(F.col("key").alias("_k"), "center")
        edges = cut_lineage(members.join(centers, F.col("key") == F.col("_k")).filter("node <> center").select("node", "center").distinct(), "edges")
        nodes = cut_lineage(members.select("node").unionByName(edges.select(F.col("center").alias("node"))).distinct(), "nodes")
        stored = self.labels.near(nodes).select(F.col("node").alias("_n"), "label")
        known = nodes.join(stored, F.col("node") == F.col("_n"), "left").select("node", F.col("label").isNull().alias("fresh"), F.coalesce("label", "node").alias("label"))
        labelled = self._rooted(known, "label")
        of = labelled.select(F.col("node").alias("_n"), F.col("label").alias("_label"))
        ends = edges.join(of, F.col("node") == F.col("_n")).select("center", F.col("_label").alias("a")).join(
            of, F.col("center") == F.col("_n")).select("a", F.col("_label").alias("b"))
        met = ends.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        joined = cut_lineage(component_labels(met).filter("node <> label").select(F.col("node").alias("label"), F.col("label").alias("root")), "joined")
        # Also the fresh ones: a later run may meet a posting whose first label was its own id.
        self.roots.merge(joined, lambda stored, new: stored.join(new.select("label"), "label", "left_anti").select("label", "root").unionByName(new))
        fresh = cut_lineage(labelled.filter("fresh").select("node", "label"), "fresh")
        self.labels.merge(fresh, lambda stored, new: stored.unionByName(new.join(stored.select("node"), "node", "left_anti").select("node", "label")))
        return joined.join(fresh.select(F.col("label").alias("_f")).distinct(), F.col("label") == F.col("_f"), "left_anti")

    def clusters(self) -> DataFrame:
        """(id_externo, cluster) of every posting."""
        return self._rooted(self.labels.read().select(F.col("node").alias("id_externo"), F.col("label").alias("cluster")), "cluster")
