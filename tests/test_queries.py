"""The registry, and a few queries end to end against the oracle on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from rolecast.plans import registry

SF = "/root/testdata/sf0.001"
SMALL = ["normalize_links", "filter_reasons", "judgement_join", "doc_bigrams", "status_events", "page_text", "feed_remotive"]


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql()) <= set(entry.oracle_sql())
    assert len(registry.queries()) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", SMALL)
def test_query_equals_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in df.select(*cols).collect()) == key(cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_scans_read_only_used_columns_and_filter_and_score_run_once(spark):
    plan = entry.queries()["doc_fingerprint_duplicates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = entry.queries()["hydrated_view"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("p_titulo") and plan.count("Generate inline(array(struct(reason") == 1
