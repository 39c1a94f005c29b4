"""Costly steps stand once in a plan and start from what is cheap (findings of round 3)."""

from pyspark.sql import functions as F

from rolecast.functions import dates
from rolecast.operators import components, entities, filters, resolve, state, windows
from rolecast.operators.versioned import PartTable
from rolecast.sources import boards

NOW = "2026-03-06 00:00:00"
RAW = "source string, entry string, fetched_at string, url string, http_status int, body string"


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_mapped_import_derives_each_id_once(spark):
    raw = spark.createDataFrame(
        [("indeed", "", NOW, "https://x/1", 200, '[{"t": "Designer", "u": "https://a.example.com/1"}]')], RAW)
    mapping = {"title": "t", "url": "u", "company": None, "location": None, "description": None, "publishedAt": None, "id": None}
    got, _ = boards.mapped_import(raw, "Indeed", mapping)
    assert _optimized(got).count("sha2(") == 1
    assert got.first().id_externo.startswith("indeed:url-")


def test_ux_remote_talent_reads_each_card_once(spark):
    body = '<div class="w-dyn-item"><a href="/ux-job/7"></a><h2 class="regular-job-title">A &amp; B</h2></div>'
    raw = spark.createDataFrame([("uxremotetalent", "", NOW, "https://www.uxremotetalent.com/p/1", 200, body)], RAW)
    got = boards.ux_remote_talent(raw, NOW)
    assert _optimized(got).count("regular-job-title") == 1
    assert [(r.id_externo, r.titulo) for r in got.collect()] == [("uxremotetalent:7", "A & B")]


def test_iso_dates_do_not_run_through_the_formats_of_rss(spark):
    texts = ["2026-03-05T10:00:00Z", "2026-03-05", "2026-13-45", " 2026-03-05", "Thu, 05 Mar 2026 10:00:00 GMT", "5 Mar 2026 10:00 +0000", "soon", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    both = df.select("i", dates.feed_date(F.col("t")).alias("a"), F.coalesce(dates.rfc822(F.col("t")), dates.loose_iso(F.col("t"))).alias("b")).collect()
    assert all(r.a == r.b for r in both) and [r.a is not None for r in sorted(both)] == [True, True, False, False, True, True, False, False]
    # What decides is one look at the text, before any format.
    assert repr(dates.feed_date(F.col("t"))).startswith("Column<'CASE WHEN rlike(t, ")


def test_first_per_key_sorts_by_a_hash_of_the_key_first(spark):
    df = spark.createDataFrame([("long-common-prefix-%d" % (i % 3), i) for i in range(9)], "k string, i int")
    got = windows.first_per_key(df, ["k"], F.col("i"))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "xxhash64(k" in plan and "Partial" in plan
    assert sorted(r.i for r in got.collect()) == [0, 1, 2] and got.columns == ["k", "i"]


def test_expunging_applies_the_rules_once(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], "id_externo string, titulo string, fonte string, n int").schema
    table = state.cache_table(spark, str(tmp_path / "cache"), schema, parts=4)
    table.replace(spark.createDataFrame([(f"a:{i}", "t", "Gupy", i) for i in range(40)], schema))
    asked = []

    def with_reason(rows, *args, **kw):
        asked.append(1)
        return rows.withColumn("reason", F.when(F.col("n") % 4 == 1, "x"))

    monkeypatch.setattr(filters, "with_reason", with_reason)
    touched = state.expunge_cache(table, NOW)
    assert touched and len(asked) == 1
    assert sorted(r.n for r in table.read().collect()) == [i for i in range(40) if i % 4 != 1]
    assert table.read().filter("titulo IS NULL OR fonte IS NULL").isEmpty() and state.expunge_cache(table, NOW) == []


def _group(spark):
    """Three rows of one entity, one of them twice, a lone row with another id in its link, a weak pair and a row without an id."""
    rows = [("a:1", "Gupy", "Designer", "Co", "https://x.example.com/1", 1), ("b:1", "Arc", "Designer", "Co", "https://x.example.com/1", 2),
            ("b:1", "Arc", "Designer", "Co", "https://x.example.com/other", 3), ("c:1", "Arc", "Writer", "We", "https://y.example.com/1", 4),
            ("d:1", "Arc", "Writer", "We", "https://y.example.com/2", 5), ("e:1", "Arc", "Cook", "Us", "https://acme.gupy.io/jobs/77", 6),
            (None, "Arc", "Cook", "Us", None, 7)]
    return spark.createDataFrame(rows, "id_externo string, fonte string, titulo string, empresa string, link string, seq bigint")


def test_entity_aliases_come_from_the_written_keys(spark):
    got = resolve.resolve(_group(spark)).aliases
    assert {tuple(r) for r in got.collect()} == {("a:1", "b:1"), ("e:1", "gupy:77")} and got.count() == 2
    assert "LogicalRDD" not in _optimized(got)


def test_weak_duplicates_come_from_the_written_keys(spark):
    got = resolve.resolve(_group(spark)).possible_duplicates
    assert {tuple(r) for r in got.collect()} == {("c:1", "d:1"), ("d:1", "c:1")}
    assert "LogicalRDD" not in _optimized(got)


def test_collisions_are_counted_from_the_written_keys(spark):
    got = resolve.collisions(resolve.resolve(_group(spark)))
    assert [r[0] for r in got.collect()] == [2] and "LogicalRDD" not in _optimized(got)
    none = resolve.collisions(resolve.resolve(_group(spark).filter("seq = 4")))
    assert [r[0] for r in none.collect()] == [0]


def test_removed_ids_read_the_cache_once_for_rows_without_an_id(spark):
    survivors, removed = resolve.reconcile(_group(spark))
    assert {r[0] for r in removed.collect()} == {"b:1", None} and survivors.count() == 4
    assert _optimized(removed).count("LogicalRDD") == 1


def test_star_edges_group_by_a_hash_of_the_key_first(spark):
    members = spark.createDataFrame([("b", "k1"), ("a", "k1"), ("c", "k2"), ("a", None), (None, "k1")], "node string, key string")
    edges = components.star_edges(members, "node", "key")
    assert [tuple(r) for r in edges.collect()] == [("b", "a")] and "xxhash64(" in _optimized(edges)


def test_only_labels_that_moved_are_followed_further(spark, tmp_path, monkeypatch):
    index = entities.EntityIndex(spark, str(tmp_path), parts=2)
    index.roots.replace(spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a")], index.roots.schema))
    written, cut = [], entities.cut_lineage
    monkeypatch.setattr(entities, "cut_lineage", lambda df, label: written.append(cut(df, label)) or written[-1])
    got = index._rooted(spark.createDataFrame([("n%d" % i, x) for i, x in enumerate("dcbaxyz")], "node string, label string"), "label")
    assert {r.node: r.label for r in got.collect()} == dict(n0="a", n1="a", n2="a", n3="a", n4="x", n5="y", n6="z")
    assert [w.count() for w in written] == [7, 3, 2, 1]


def test_entity_clusters_by_day_write_a_large_part_by_several_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        table = PartTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k string, v string").schema, ["k"], parts=1)
        table.replace(spark.range(0, 40000, 1, 8).selectExpr("CAST(id AS STRING) AS k", "sha1(CAST(id AS STRING)) AS v"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(table.read().inputFiles()) > 1 and table.read().distinct().count() == 40000
