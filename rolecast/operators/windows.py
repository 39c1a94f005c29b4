"""Ordered analytics over event logs (WIN-01 … WIN-08).

One id may own a third of all events, so no window may need the whole history
of an id in one task.  Two shapes avoid it:

* "first/last n per key" is written as ``row_number() <= n``, which Spark cuts
  to n rows per key before the shuffle (window group limit);
* "previous value" and "running total" cut the rows by range over (key, order)
  into parts of about equal size, whatever a key's share, with a window inside
  a part and one summary row per key and part across parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.operators.shaping import cut_lineage

_PART = "_part"


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """WIN-01, WIN-02: the first row of each key in the given order."""
    # Keys often begin alike, so that a sort has to compare them whole; their hash in front tells most apart at once.
    w = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def prefer_described(df: DataFrame, key: str = "link", seq: str = "seq") -> DataFrame:
    """WIN-02: per URL the row that has a description, else the first one."""
    described = F.coalesce(F.length("descricao"), F.lit(0)) > 0
    # Equal places, as of pages that list a posting each, fall back on the content.
    return first_per_key(df, [key], F.desc(described), F.col(seq), F.xxhash64(*[F.col(c) for c in df.columns if c != seq]))


def last_n(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """WIN-03: the n latest rows per key, with ``rn`` = 1 for the latest."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def history_tail(df: DataFrame, key: str, n: int, order: list[str], row: list[str]) -> DataFrame:
    """WIN-03: the n latest events of each key as one array, oldest first."""
    recent = last_n(df, key, n, *[F.desc(c) for c in order])
    return recent.groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("o"), F.struct(*row).alias("e")))),
        lambda x: x["e"]).alias("historico"))


def _in_parts(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with the number of their part, in ascending order of (key, order).

    Written, because the cuts of a range partitioning are drawn anew each time it
    is computed, and the levels above have to agree on them.
    """
    cut = df.repartitionByRange(F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
    return cut_lineage(cut.withColumn(_PART, F.spark_partition_id()), "parts")


def with_previous(df: DataFrame, key: str, order: list[str], values: list[str], prefix: str = "ant_") -> DataFrame:
    """WIN-04, WIN-06, WIN-08: the previous row's values within the key.

    The window runs inside (key, part); only the first row of a part looks at
    the last row of the key in the parts before.
    """
    parts = _in_parts(df, key, order)
    inside = Window.partitionBy(key, _PART).orderBy(*order)
    payload = F.struct(*values)
    local = parts.withColumn("_prev", F.lag(payload).over(inside)).withColumn("_n", F.row_number().over(inside))
    last = parts.groupBy(key, _PART).agg(F.max_by(payload, F.struct(*order)).alias("_last"))
    carried = last.select(
        F.col(key).alias("_k"), F.col(_PART).alias("_p"), F.lag("_last").over(Window.partitionBy(key).orderBy(_PART)).alias("_carry"))
    joined = local.join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col(_PART) == F.col("_p")), "left").drop("_k", "_p")
    prev = F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    return joined.select(*df.columns, prev.alias("_p")).select(
        *df.columns, *[F.col(f"_p.{v}").alias(prefix + v) for v in values])


def with_running_sum(df: DataFrame, key: str, order: list[str], amount: str, name: str = "acumulado") -> DataFrame:
    """Running total per key in two levels, as in :func:`with_previous`."""
    parts = _in_parts(df, key, order)
    inside = Window.partitionBy(key, _PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy(key, _PART).agg(F.sum(amount).alias("_s"))
    before = Window.partitionBy(key).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(key).alias("_k"), F.col(_PART).alias("_p"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    return (
        parts.withColumn("_in", F.sum(amount).over(inside))
        .join(offsets, F.col(key).eqNullSafe(F.col("_k")) & (F.col(_PART) == F.col("_p")))
        .select(*df.columns, (F.col("_in") + F.col("_off")).alias(name)))


def latest_status(events: DataFrame, key: str = "id", order: tuple = ("em",), status: str = "para") -> DataFrame:
    """WIN-03: the current status of each id; a grouped maximum, no window."""
    return events.groupBy(key).agg(
        F.max_by(status, F.struct(*order)).alias("status"), F.max(order[0]).alias("desde"))


def status_as_of(events: DataFrame, instant: Column, key: str = "id", order: tuple = ("em",),
                 status: str = "para") -> DataFrame:
    """WIN-05: the status each id had at an instant."""
    return latest_status(events.filter(F.col(order[0]) <= instant), key, order, status)


def as_of_join(probes: DataFrame, events: DataFrame, key: str, at: str, when: str, order: list[str], values: list[str],
               prefix: str = "vigente_") -> DataFrame:
    """WIN-05: each probe row with the values of its key's last event at or before its own instant.

    Probes and events are ordered together by (key, instant), cut by range into parts, and the last event is carried
    along: inside a part by a window, across parts by one row per key and part.  So neither a key with very many events
    nor one with very many probes meets in one task.  ``order`` decides among events of one instant.  A probe without key
    or instant, or before its key's first event, gets nulls.
    """
    probe = F.struct(*[F.col(c) for c in probes.columns])
    value = F.struct(*[F.col(c) for c in values])
    kinds = {c: events.schema[c].dataType for c in order}
    asked = probes.select(
        F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_is"), *[F.lit(None).cast(t).alias(f"_o{i}") for i, t in enumerate(kinds.values())],
        probe.alias("_row"), F.lit(None).cast(events.select(value.alias("v")).schema["v"].dataType).alias("_val"))
    told = events.filter(F.col(key).isNotNull() & F.col(when).isNotNull()).select(
        F.col(key).alias("_k"), F.col(when).alias("_t"), F.lit(0).alias("_is"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), value.alias("_val"))
    along = ["_t", "_is", *[f"_o{i}" for i in range(len(order))]]
    parts = _in_parts(asked.unionByName(told), "_k", along)
    inside = Window.partitionBy("_k", _PART).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("_here", F.last("_val", ignorenulls=True).over(inside)).filter("_is = 1")
    last = parts.filter("_is = 0").groupBy("_k", _PART).agg(F.max_by("_val", F.struct(*along)).alias("_last"))
    # One row for each key and part that has events, so that a part without any finds the one before.
    spans = parts.select("_k", _PART).distinct().join(last, ["_k", _PART], "left")
    before = Window.partitionBy("_k").orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(F.col("_k").alias("_ck"), F.col(_PART).alias("_cp"), F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    joined = local.join(carried, (F.col("_k") == F.col("_ck")) & (F.col(_PART) == F.col("_cp")), "left")
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_here", "_carry"))
    return joined.select("_row.*", found.alias("_found")).select(
        *probes.columns, *[F.col(f"_found.{v}").alias(prefix + v) for v in values])


def transitions(events: DataFrame, key: str = "id", order: tuple = ("em", "seq"), status: str = "para") -> DataFrame:
    """WIN-04: (de → para) of each event; equal consecutive statuses are no move."""
    moved = with_previous(events, key, list(order), [status])
    return moved.withColumnRenamed(f"ant_{status}", "de").filter(F.col("de").isNull() | (F.col("de") != F.col(status)))


def chain_breaks(df: DataFrame, key: str, order: str, points_to: str, points_from: str) -> DataFrame:
    """WIN-06: rows whose incoming cursor is not the previous row's outgoing one."""
    linked = with_previous(df, key, [order], [points_to])
    return linked.withColumn("ok", F.col(points_from).eqNullSafe(F.col(f"ant_{points_to}")))


def revision_chain(deliveries: DataFrame) -> DataFrame:
    """WIN-08: revision n must replace the delivery of revision n - 1 of its task.

    A self equi join on (task, revision): no ordering of a task's history is needed.
    """
    prev = deliveries.select(
        "task_id", (F.col("revisao") + 1).alias("revisao"), F.col("entrega_id").alias("_anterior"))
    return deliveries.join(prev, ["task_id", "revisao"], "left").withColumn(
        "ok", F.when(F.col("revisao") == 1, F.col("substitui_id").isNull())
        .otherwise(F.coalesce(F.col("substitui_id") == F.col("_anterior"), F.lit(False)))).drop("_anterior")


def latest_successful(runs: DataFrame, by: str, when: str, ok: Column, payload: list[str]) -> DataFrame:
    """WIN-07: the latest run that succeeded, per source."""
    return runs.filter(ok).groupBy(by).agg(F.max_by(F.struct(*payload), F.struct(when, *payload)).alias("run")).select(
        by, "run.*")
