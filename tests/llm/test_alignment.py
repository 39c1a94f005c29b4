"""Token alignment against a merge of the two end lists, and on awkward texts."""

import collections
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolecast.llm import queries
from rolecast.llm import token_alignment as ta

pytestmark = pytest.mark.skipif(not os.path.isdir(ta.FOLDER), reason="vocabulary files are not here")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    return ta.Vocabularies.of(*ta.vocabulary_files())


def by_merge(both, text):
    """(groups, links) of one text by walking both lists, None without tokens."""
    if not text:
        return None
    a, b = both.slow.encode(" " + text, add_special_tokens=False).ids, both.pieces.encode(text)
    whole = (" " + text).encode()
    if b"".join(both.a_bytes[i] for i in a) != whole or b"".join(both.b_bytes[i] for i in b) != whole:
        return None
    groups, links, i, j, run_a, run_b = [], [], 0, 0, [a[0]], [b[0]]
    end_a, end_b = len(both.a_bytes[a[0]]), len(both.b_bytes[b[0]])
    while True:
        links.append((a[i], b[j]))
        same = end_a == end_b
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if same:
            groups.append((run_a, run_b))
            run_a, run_b = [], []
            if i + 1 == len(a):
                return groups, links
        if step_a:
            i += 1
            end_a += len(both.a_bytes[a[i]])
            run_a.append(a[i])
        if step_b:
            j += 1
            end_b += len(both.b_bytes[b[j]])
            run_b.append(b[j])


def expected(both, texts):
    """Result columns of each text."""
    found = [by_merge(both, t) for t in texts]
    held = collections.Counter(pair for f in found if f for pair in set(f[1]))
    top = collections.Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = f
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


def test_query_equals_a_merge_of_the_lists(spark, both):
    got = {r.doc_id: tuple(r[c] for c in ta.RESULTS) for r in queries.op11_token_alignment(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in docs], expected(both, [r.text for r in docs])))


def test_awkward_texts_and_columns(spark, both):
    rnd = random.Random(5)
    letters = "ab é ß\n\t  漢字カ😀▁<>|0x0Ačñ \u0085'́s\u0000" + "the and "
    texts = [None, "", " ", "  x", "a▁b", "<s></s><unk><|endoftext|><0x0A>", "don't 12 345", "x" * 3000, "word " * 40_000,
             "﻿é", *["".join(rnd.choices(letters, k=rnd.randrange(1, 60))) for _ in range(300)], "the same", "the same"]
    rows = [(None if i % 7 == 0 else i % 50, t, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, chunk string, n_a string").repartition(3)
    out = ta.aligned_documents(docs, chunk_bytes=5000)
    assert out.columns == ["doc_id", "text", "chunk", *ta.RESULTS]
    want = collections.Counter(zip([r[0] for r in rows], texts, expected(both, texts)))
    assert collections.Counter((r.doc_id, r.text, tuple(r[c] for c in ta.RESULTS)) for r in out.collect()) == want
    assert ta.aligned_documents(docs.limit(0)).count() == 0
    assert ta.aligned_documents(docs.filter("text IS NULL")).select("n_a", "groups_sha256").distinct().collect() == [(0, "")]
    bad = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("CAST(X'61FF62' AS STRING)").alias("text"))
    assert ta.aligned_documents(bad, keep=["doc_id"]).collect()[0].n_links == 0


def test_both_byte_level_forms_agree(both):
    """Every token by itself, every character of the alphabets that the ranked form gets, and mixed texts."""
    assert both.fast is not None
    rnd = random.Random(2)
    near = [chr(c) for c in range(0x250)]
    texts = [x.decode() for x in both.a_bytes if x.isascii()] + [a + b for a in "a1 .\n'" for b in near] + [a + b for a in near for b in "a1 .\n'"]
    texts += ["".join(rnd.choices(near, k=30)) for _ in range(3000)]
    raws = [t.encode() for t in texts]
    assert not any(max(r, default=0) >= ta._FAR for r in raws)
    assert both.encode_a(raws, texts) == [e.ids for e in both.slow.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_gallop_finds_ranks():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        longer = np.unique(rnd.integers(0, 500, rnd.integers(1, 80)))
        keys = np.unique(rnd.integers(0, longer[-1] + 1, rnd.integers(1, 40)))
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(longer))
        start = rnd.integers(-3, len(longer) + 3, len(keys))
        assert (ta.gallop(keys, longer, low, high, start) == np.searchsorted(longer, keys)).all()


def test_groups_cover_the_bytes(spark, both):
    text = "unbelievable tokenization, naïve façade 漢字"
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id bigint, text string")
    rows = ta.token_groups(docs).orderBy("doc_id", "first_byte").collect()
    whole = (" " + text).encode()
    assert [r.doc_id for r in rows] == [1] * len(rows) and rows[-1].end_byte == len(whole)
    for r in rows:
        part = whole[r.first_byte: r.end_byte]
        assert b"".join(both.a_bytes[i] for i in r.a_ids) == part == b"".join(both.b_bytes[i] for i in r.b_ids)
