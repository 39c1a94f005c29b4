"""Keyed tables that change part by part and switch in one step."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolecast.operators.versioned import PART, ConcurrentWrite, PartTable

SCHEMA = StructType().add("id", "string").add("n", "long")


def add(stored, changes):
    old = stored.select(F.col("id").alias("_id"), F.col("n").alias("_n"))
    return old.join(changes, F.col("_id") == F.col("id"), "full").select(
        F.coalesce("id", "_id").alias("id"), (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n")).filter("n <> 0")


@pytest.fixture
def table(spark, tmp_path):
    return PartTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], parts=8)


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def put(spark, table, values, **more):
    return table.merge(spark.createDataFrame(values, SCHEMA), add, **more)


def test_a_change_rewrites_only_the_parts_of_its_keys(spark, table, tmp_path):
    assert rows(table) == []
    put(spark, table, [(f"k{i}", 1) for i in range(40)])
    first = dict(table.manifest()["parts"])
    assert len(first) == 8
    touched = put(spark, table, [("k3", 5)])
    second = table.manifest()["parts"]
    assert len(touched) == 1 and {p for p in second if second[p] != first[p]} == {str(touched[0])}
    folder = tmp_path / "t" / "data" / second[str(touched[0])]
    assert [x for x in os.listdir(folder) if x.startswith(PART)] == [f"{PART}={touched[0]}"]
    assert dict(rows(table))["k3"] == 6 and len(rows(table)) == 40 and dict(rows(table, 1))["k3"] == 1


def test_keys_may_be_null_and_parts_may_become_empty(spark, table):
    put(spark, table, [(None, 1), ("a", 2)])
    assert table.read().count() == 2
    put(spark, table, [("a", -2)])
    assert rows(table) == [(None, 1)]
    table.replace(spark.createDataFrame([], SCHEMA))
    assert rows(table) == [] and table.manifest()["parts"] == {}


def test_a_failing_write_leaves_the_old_version(spark, table):
    put(spark, table, [("a", 1), ("b", 2)])
    broken = lambda stored, changes: changes.withColumn("n", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(PySparkException):
        table.merge(spark.createDataFrame([("a", 9)], SCHEMA), broken)
    assert rows(table) == [("a", 1), ("b", 2)] and table.manifest()["version"] == 1
    put(spark, table, [("a", 9)])
    assert rows(table) == [("a", 10), ("b", 2)]


def test_a_batch_counts_once(spark, table):
    for batch in (0, 0, 1, 0, 1):
        put(spark, table, [("a", 1)], batch=batch)
    assert rows(table) == [("a", 2)] and table.manifest()["batch"] == 1


def test_a_second_writer_fails_and_loses_nothing(spark, table):
    put(spark, table, [("a", 1)])

    def meanwhile(stored, changes):
        put(spark, PartTable(spark, table.path, SCHEMA, ["id"], parts=8), [("a", 10)])
        return add(stored, changes)

    with pytest.raises(ConcurrentWrite):
        table.merge(spark.createDataFrame([("a", 100)], SCHEMA), meanwhile)
    assert rows(table) == [("a", 11)]


def test_a_fold_that_moves_rows_to_other_parts_is_refused(spark, table):
    put(spark, table, [(f"k{i}", 1) for i in range(40)])
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([("k1", 1)], SCHEMA), lambda s, c: s.withColumn("id", F.concat("id", F.lit("x"))))
    assert table.read().filter("id LIKE '%x'").count() == 0
    with pytest.raises(ValueError):
        PartTable(spark, table.path, SCHEMA, ["id"], parts=4).read()


def test_rewrite_touches_the_parts_with_hits_and_old_files_go(spark, table, tmp_path):
    put(spark, table, [(f"k{i}", i) for i in range(1, 41)], facts={"a": 1})
    touched = table.rewrite(lambda rows: rows.filter("n = 7"), lambda stored: stored.filter("n <> 7"), {"b": 2})
    assert len(touched) == 1 and "k7" not in dict(rows(table)) and len(rows(table)) == 39
    assert table.facts() == {"a": 1, "b": 2} and table.rewrite(lambda rows: rows.filter("n = 7"), lambda s: s) == []
    for _ in range(3):
        table.replace(spark.createDataFrame([("z", 1)], SCHEMA))
    named = {v for n in table._numbers() for v in table.manifest(n)["parts"].values()}
    assert {x for x in os.listdir(tmp_path / "t" / "data") if not x.startswith(".")} == named
    assert len(table._numbers()) == 2
