"""The line index against plain counting, its reversibility, and the cuckoo filter."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rolecast.llm import line_index
from rolecast.llm.cuckoo import CuckooFilter, Full, filled

WHITE = " \t\n\v\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def plain(texts, min_docs, corpus=None):
    """(n_lines, n_dropped, kept text) of each text by the counts of ``corpus``."""
    held = collections.Counter(k for t in (texts if corpus is None else corpus) for k in {key(x) for x in (t or "").split("\n")} - {""})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if held[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def found(df):
    return collections.Counter((r.doc_id, tuple(r.lines)) for r in df.select("doc_id", "lines").collect())


def expected(rows, corpus, min_docs):
    return collections.Counter(zip([i for i, _ in rows], plain([t for _, t in rows], min_docs, corpus)))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    pool = ["Read more", "read MORE \t", "\x0b© all\xa0rights", "é", "É", "", "  ", *[f"line {i % 23}" for i in range(60)]]
    texts = ["\n".join(rnd.choices(pool, k=rnd.randrange(0, 9))) for _ in range(150)] + [None, "", "\n\n", "one\r\ntwo\r", "a" * 70_000]
    return [(None if n % 11 == 0 else n % 120, t) for n, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, lines string, chunk string").repartition(3)


def test_lines_of_many_documents_go(spark, rows):
    docs = frame(spark, rows)
    out = line_index.drop_common_lines(docs, min_docs=10, shards=5)
    assert out.columns == ["doc_id", "chunk", "lines"]
    assert found(out) == expected(rows, [t for _, t in rows], 10)
    assert line_index.drop_common_lines(docs.limit(0)).count() == 0
    few = docs.filter("text IS NULL")
    assert [tuple(r.lines) for r in line_index.drop_common_lines(few, min_docs=1).collect()] == [(1, 0, "")]


def test_documents_go_in_and_out(spark, rows, tmp_path):
    """After a deletion the index is the one of the documents that are left, shard by shard and filter by filter."""
    first, second = rows[:90], rows[90:]
    a, b = (line_index.LineChunks(frame(spark, r), chunk_bytes=2000) for r in (first, second))
    state = lambda index: sorted((r.key, r.n) for r in index.counts().collect())
    index = line_index.LineIndex(spark, str(tmp_path / "i"), min_docs=6, shards=7)
    index.insert(a, batch=0)
    alone = state(index)
    index.insert(b, batch=1)
    assert index.insert(b, batch=1) == [] and found(index.clean(a)) == expected(first, [t for _, t in rows], 6)
    index.delete(b, batch=2)
    assert state(index) == alone and found(index.clean(b)) == expected(second, [t for _, t in first], 6)
    held = index.table.read().filter("key IS NULL").select("shard", "cells", "n").collect()
    due = {r.shard: [] for r in held}
    for r in index.counts().filter("n >= 6").collect():
        due[r.shard].append(r.key)
    for r in held:
        assert CuckooFilter(cells=r.cells).contains(due[r.shard]).all() and r.n == len(due[r.shard])
        # The filter holds one fingerprint per key that is due, none of those that left it.
        assert int((CuckooFilter(cells=r.cells).cells > 0).sum()) == len(due[r.shard])
    index.delete(a)
    assert state(index) == [] and index.dropped(a.asked).count() == 0
    index.delete(a)
    assert state(index) == []


def test_a_change_of_few_keys_reads_few_shards(spark, tmp_path):
    index = line_index.LineIndex(spark, str(tmp_path / "i"), min_docs=2, shards=16)
    index.insert(line_index.LineChunks(frame(spark, [(i, f"line {i}") for i in range(200)])))
    before = index.table.manifest()["parts"]
    touched = index.insert(line_index.LineChunks(frame(spark, [(900, "line 7")])))
    after = index.table.manifest()["parts"]
    assert len(touched) == 1 and {p for p in after if after[p] != before.get(p)} == {str(touched[0])}


def test_very_common_line_costs_one_row_a_chunk(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Common\nown "), "id").alias("text"))
    chunks = line_index.LineChunks(docs)
    common = line_index.line_key(b"common")
    asked = chunks.asked.filter(F.col("key") == F.lit(common)).agg(F.count("*"), F.sum("held"), F.count_distinct("chunk")).first()
    assert asked[0] == asked[2] < 20 and asked[1] == 20_000


def test_filter_finds_what_is_in_it_and_forgets_what_leaves():
    digests = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(30_000)]
    table = filled(digests[:10_000])
    assert table.contains(digests[:10_000]).all()
    assert table.contains(digests[10_000:]).mean() < 0.001
    table.remove(digests[:5_000])
    assert table.contains(digests[5_000:10_000]).all() and table.contains(digests[:5_000]).mean() < 0.001
    again = CuckooFilter(cells=table.tobytes())
    assert (again.cells == table.cells).all()
    small = CuckooFilter(8).add(digests[:8])
    before = small.cells.copy()
    with pytest.raises(Full):
        small.add(digests[:200])
    assert (small.cells == before).all()
    assert not CuckooFilter(0).contains(digests[:3]).any() and len(CuckooFilter(0).contains([])) == 0
