"""Spelling variants against plain search for neighbours."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rolecast.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SF = "/root/testdata/sf0.001"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def counted(rows, least=5, min_count=3, every=97):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if every and h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= least:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= min_count}


def near(words):
    """Words at distance one of each word, by the patterns that one edit leaves."""
    by = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by["replace", w[:i], w[i + 1:]].add(w)
            by["delete", w[:i] + w[i + 1:]].add(w)
    found = collections.defaultdict(set)
    for k, group in by.items():
        if k[0] == "replace":
            for w in group:
                found[w] |= group - {w}
        elif k[1] in words:
            for w in group:
                found[w].add(k[1])
                found[k[1]].add(w)
    return found


def expected(rows, times=2, **options):
    words = counted(rows, **options)
    by = near(words)
    form = {}
    for w, n in words.items():
        best = min(by[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(by[w]), words.get(form[w])))
    return sorted(out)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_query_equals_plain_search(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = expected(rows)
    assert got(queries.op13_spelling_pivots(spark, SF)) == want and sum(r[1] is not None for r in want) > 10


def test_dense_neighbourhoods_chains_and_awkward_rows(spark):
    """Words of few letters, where nearly all are near, with counts that make long chains."""
    rnd = random.Random(4)
    pool = ["".join(rnd.choices("abcé", k=rnd.randrange(4, 8))) for _ in range(1500)] + ["aaaaa", "aaaaaa", "ababab", "babababa", "÷×÷×÷"]
    rows = [(None if i % 9 == 0 else i, " ".join(rnd.choices(pool, weights=[1 / (k + 1) for k in range(len(pool))], k=300)).title())
            for i in range(120)]
    # Each word one letter off the next, four times as common as it.
    chain = ["zzzzzzzzz"[:9 - k] + "yyyyyyyyy"[:k] for k in range(8)]
    rows += [(1000 + k, f"{w} " * 3 * 4**k) for k, w in enumerate(chain)]
    rows += [(1, None), (2, ""), (3, "1234 漢字 Ÿ ſ ĀĀĀĀĀĀ"), (5, "x" * 50_000), (5, "x" * 50_000), (5, "x" * 50_000), (6, "éÉàÿÀ " * 9), (6, "éÉàÿÀ " * 9)]
    long = "".join(rnd.choices("abc", k=258))
    rows += [(2000, f"{w} " * n) for w, n in ((long, 20), (long[1:], 9), (long[:255] + long[256:], 40), (long[:-3], 4), (long[:-4], 3), ("b" + long[1:], 99))]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, word string, n string").repartition(4)
    for options in ({}, {"every": 0}, {"every": 3, "min_count": 1, "least": 4}):
        want = expected(rows, **options)
        assert got(spelling.variants(docs, **options)) == want
    assert any(r[0] == chain[0] and r[2] == chain[-1] for r in expected(rows, every=0))
    assert spelling.variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(docs, least=3)


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", min_size=4, max_size=9), st.integers(0, 8), st.sampled_from("abcdé"), st.sampled_from(["insert", "delete", "replace"]))
def test_a_pivot_of_one_word_stands_in_the_others_prefix(word, at, letter, kind):
    at %= len(word)
    other = {"insert": word[:at] + letter + word[at:], "delete": word[:at] + word[at + 1:], "replace": word[:at] + letter + word[at + 1:]}[kind]
    if other == word or len(other) < 4:
        return
    rnd = random.Random(at + len(word))
    grams = sorted({w[i: i + 2] for w in (word, other) for i in range(len(w) - 1)})
    rnd.shuffle(grams)
    order = {g: i for i, g in enumerate(grams)}

    def parts(w, places, more):
        def part(_, begin, end):
            return np.array([zlib.crc32(w[i:j].encode()) + ((j - i) << 40) for i, j in zip(begin, end)], np.uint64)

        at = np.array(places)
        found = spelling._asked(part, np.zeros(len(at), int), at, np.full(len(at), len(w)), more)
        return {(k, x) for k, (_, h) in enumerate(found) for x in h.tolist()}

    (pivots, prefix), (more, extra) = spelling.word_keys(word, order), spelling.word_keys(other, order)
    assert len(pivots) == len(more) == 2 and all(abs(a - b) >= 2 for a, b in (pivots, more))
    longer = len(other) - len(word)
    assert parts(word, pivots, longer) & parts(other, extra, 0) or parts(other, more, -longer) & parts(word, prefix, 0)


def test_pivots_are_the_rarest_pair_that_does_not_overlap():
    rnd = np.random.default_rng(0)
    for _ in range(300):
        places = np.sort(rnd.choice(12, rnd.integers(3, 7), replace=False))
        ranks = rnd.integers(0, 50, len(places))
        pairs = [(ranks[i] + ranks[j]) for i in range(len(places)) for j in range(i) if abs(places[i] - places[j]) >= 2]
        chosen = spelling.pivot_places(places, ranks)
        cost = dict(zip(places.tolist(), ranks.tolist()))
        assert len(chosen) == 2 and abs(chosen[0] - chosen[1]) >= 2 and sum(cost[p] for p in chosen) == min(pairs)


def test_crcs_go_on_from_a_state():
    words = [b"", b"a", "éà".encode(), b"abcdefgh" * 9]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    states = [b"", b"12:", b"-7:", b":"]
    found = spelling.span_crcs(data, starts, ends, np.array([zlib.crc32(s) for s in states], np.uint32))
    assert found.tolist() == [zlib.crc32(s + w) for s, w in zip(states, words)]
