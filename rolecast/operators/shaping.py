"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, whatever reads them later.

    A plain ``withColumn`` is only an alias: a filter that moves below it takes
    a copy of the expression along.  A generated column stays where it is, so
    the folded title or body is not folded again by every rule.  The generator
    only passes on what the projection below it has computed in compiled code;
    expressions inside a generator are interpreted as soon as one has a lambda.
    """
    computed = df.select("*", *[c.alias(f"_bound_{name}") for name, c in columns.items()])
    row = F.struct(*[F.col(f"_bound_{name}").alias(name) for name in columns])
    return computed.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(row)))


def col_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column when the frame has it, else a typed NULL."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the session names it.

    Only a local session without the setting gets a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="rolecast-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for a table written between two steps."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a frame to the shared folder and go on from the written table.

    The table is computed once, survives lost executors, and its size is known
    to the planner, which a checkpointed RDD's is not.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
