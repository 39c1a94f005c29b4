"""Operators against brute force, exact round trips, held-out accuracy or their oracle."""

import collections
import hashlib
import html
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolecast.llm import (
    adaptive_scan, backoff_lm, bag_minhash, chat_windows, decontaminate, html_main, licenses, mixing, quality, queries, repeats, suffix_groups,
)
from rolecast.llm import textbytes as tb

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").lower())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_word_arrays_equal_python(texts):
    some = list(texts.values())[:50] + ["", None, "É a", "a"]
    for row, end, raw, offsets in tb.chunks(pa.array(some), 5000):
        data = tb.lower_latin(raw)
        starts, ends, bounds = tb.words(data, offsets)
        got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        assert [got[bounds[k]: bounds[k + 1]] for k in range(end - row)] == [words(t) for t in some[row:end]]
        hashes = tb.span_hashes(data, starts, ends)
        assert all(tb.word_hash(w) == h for w, h in zip(got, hashes))


def test_chats_are_read_back(spark):
    rnd = random.Random(1)
    rows = [(c, None if rnd.random() < .05 else rnd.randrange(300), rnd.choice(["system", "user", "assistant", "assistant", None, "we<i\\rd>"]),
             rnd.choice([None, "", "a b c", "\\<\\</turn>\n<turn:user>", "x " * rnd.randrange(90), "é\\"]))
            for c, n in ((None, 5), (1, 400), (2, 3), (3, 40)) for _ in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for options in ({"budget": 60, "history": 20, "segment": 2, "turn_block": 8}, {"budget": 30, "history": 0, "segment": 1}, {}):
        made = chat_windows.windows(turns, **options).cache()
        assert made.filter(~F.col("over_budget") & (F.col("tokens") > options.get("budget", 1024))).count() == 0
        # Only a turn that does not fit by itself goes over.
        assert made.filter("over_budget AND size(filter(new, x -> x)) > 2").count() == 0
        for r in chat_windows.read_back(made).collect():
            want = sorted(by[r.conv_id])
            said = "".join(x for _, _, role, x in want if role == "assistant")
            assert r.n_turns == len(want) and r.loss_chars == len(said)
            assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, _, role, x in want).encode()).hexdigest()
            assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_windows_repeat_history_and_keep_the_system_turn(spark):
    rows = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2], f"w{i} " * 5) for i in range(30)]
    made = chat_windows.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=60, history=20)
    found = made.orderBy("window_start").collect()
    assert len(found) > 3 and all(r.places[0] == 0 for r in found)
    assert [p for r in found for p, new in zip(r.places, r.new) if new] == list(range(30))
    for r in found[1:]:
        repeated = [p for p, new in zip(r.places, r.new) if not new][1:]
        assert repeated == list(range(r.window_start - len(repeated), r.window_start)) and len(repeated) == 2


def test_quality_on_held_out_documents(spark):
    out = queries.op2_quality_lines(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    row = out.filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert row[1] > 500 and row[0] > 0.98


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    bounds = np.array([0, 1, 5, 7])
    s, steps = rng.normal(size=7), rng.normal(size=(2, 2))
    good, pair = quality.marginals(s, steps, bounds)
    for a, b in zip(bounds[:-1], bounds[1:]):
        total, one, two = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for code in range(2 ** (b - a)):
            y = [(code >> i) & 1 for i in range(b - a)]
            p = math.exp(sum(s[a + i] * v for i, v in enumerate(y)) + sum(steps[u, v] for u, v in zip(y, y[1:])))
            total += p
            one += p * np.array(y)
            for i in range(1, b - a):
                two[i, y[i - 1], y[i]] += p
        assert np.allclose(good[a:b], one / total) and np.allclose(pair[a:b], two / total)


PAGE = "<html><body><div class=x1>{menu}</div><div class=x2><h2>{title}</h2><p>{text}</p></div><div class=x3>{foot}</div></body></html>"


def test_recurring_subtrees_go_without_marks(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(menu="Home About", title=f"T{i}", text=f"text {i}", foot="All rights")) for i in range(40)]
    rows.append((99, "http://h2.org/1", PAGE.format(menu="Home About", title="T", text="only", foot="All rights")))
    out = {r.page_id: r.main_text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[7] == "T7\ntext 7" and out[99] == "Home About\nT\nonly\nAll rights"


def test_articles_are_read_whole(spark):
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = queries.op3_site_templates(spark, SF).collect()
    assert len(out) == len(raw)
    for r in out:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", raw[r.page_id], re.S)[1]
        lines = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_nearest_neighbours_reach_the_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    got = collections.defaultdict(dict)
    for r in queries.op4_adaptive_scan(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id][r.vec_id] = r.score
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = (x * x[i]).sum(axis=1) / (norm * norm[i])
        score[i] = -2
        best = np.lexsort((ids, -score))[:5]
        assert len(got[ids[i]]) == 5
        hit, total = hit + len(set(ids[best]) & set(got[ids[i]])), total + 5
        where = {v: s for v, s in zip(ids, score)}
        assert all(abs(where[v] - s) < 1e-12 for v, s in got[ids[i]].items())
    assert hit / total >= 0.9


def test_copies_of_a_vector_split_over_parts(spark):
    rows = [(i, [1.0, 1.0] if i < 300 else [1.0, float(i)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = adaptive_scan.search(frame, lambda key: F.pmod(key, F.lit(50)) == 0, part_size=16).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in out[:5]] == [1, 2, 3, 4, 5] and [r.vec_id for r in out[5:10]] == [0, 1, 2, 3, 4]


def test_leaks_equal_search_for_exact_passages(spark, texts):
    items = {r.item_id: " ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    flat = {d: f" {' '.join(words(t))} " for d, t in texts.items()}
    want = {(d, i) for i, item in items.items() for d, t in flat.items() if f" {item} " in t}
    got = {(r.doc_id, r.item_id) for r in queries.op5_latent_leaks(spark, SF).collect()}
    assert want and len(want - got) <= 0.05 * len(want) and not got - want


def test_paraphrases_need_their_answer(spark):
    rnd = random.Random(4)
    item = [f"w{rnd.randrange(3000)}" for _ in range(40)]
    changed = [w if k % 3 else f"v{k}" for k, w in enumerate(item[:-7])]
    filler = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(300)) for _ in range(60)]
    rows = [(100, filler[0] + " " + " ".join(changed + item[-7:])), (101, filler[1] + " " + " ".join(changed + ["u"] * 7)),
            (102, filler[2] + " " + " ".join(item).upper())] + list(enumerate(filler))
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).select("doc_id", F.inline("leaks")).collect()
    assert {(r.doc_id, r.kind) for r in found} == {(100, "paraphrase"), (102, "near")}


def test_a_long_item_does_not_widen_short_ones(spark):
    """Clean long documents hold a short item's words in order, but far apart."""
    rnd = random.Random(6)
    item = [f"w{k}" for k in range(15)]
    filler = lambda n: [f"v{rnd.randrange(3000)}" for _ in range(n)]
    apart = [[x for w in item for x in (w, *filler(100))] for _ in range(5)]
    rows = [(k, " ".join(w)) for k, w in enumerate(apart)] + [(10, " ".join(filler(200) + item + filler(200)))]
    long = filler(1000)
    rows.append((11, " ".join(filler(77) + long + filler(300))))
    both = [(1, " ".join(item)), (2, " ".join(long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [{(r.doc_id, r.item, r.common) for r in decontaminate.find_leaks(
        docs, spark.createDataFrame(some, "item_id long, text string")).select("doc_id", F.inline("leaks")).collect()} for some in (both, both[:1])]
    assert found == [{(10, 1, 15), (11, 2, 1000)}, {(10, 1, 15)}]


def test_no_exact_passage_is_lost(spark, texts):
    items = {r.item_id: " ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    flat = {d: f" {' '.join(words(t))} " for d, t in texts.items()}
    want = {(d, i) for i, item in items.items() for d, t in flat.items() if f" {item} " in t}
    assert {(r.doc_id, r.item_id) for r in queries.op5_latent_leaks(spark, SF).collect()} == want


def test_cosine_decides_about_no_leak(spark, monkeypatch):
    """Words without any weight in the latent directions."""
    none = np.zeros((decontaminate.TERMS, decontaminate.DIMS), np.float32), np.ones(decontaminate.TERMS, np.float32)
    monkeypatch.setattr(decontaminate, "latent_map", lambda *_: none)
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"a b c {item} d e"), (2, "a b c d e")], "doc_id long, text string")
    found = decontaminate.find_leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert [(r.doc_id, r.item) for r in found.select("doc_id", F.inline("leaks")).collect()] == [(1, 5)]


def test_common_subsequence_equals_table():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == table[-1][-1]


def test_signatures_estimate_weighted_similarity():
    shared = [f"w{i}" for i in range(400)]
    pair = [" ".join(shared + ["rep"] * 60), " ".join(shared[:350] + ["rep"] * 25 + [f"z{i}" for i in range(40)])]
    (_, _, shingles, bounds), = bag_minhash.text_shingles(pa.array(pair))
    sig = bag_minhash.signatures(*bag_minhash.bags(shingles, bounds), 2, 4096)
    exact = bag_minhash.pair_similarity(pa.array(pair[:1]), pa.array(pair[1:]))[0]
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def _shingle_bag(text):
    w = words(text)
    return collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def test_classes_equal_brute_force(spark, texts):
    order = sorted(texts)
    bags = {d: _shingle_bag(texts[d]) for d in order}
    inverted, shared = collections.defaultdict(list), set()
    for d in order:
        for s in bags[d]:
            shared.update((e, d) for e in inverted[s])
            inverted[s].append(d)
    parent = {d: d for d in order}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    by_text = {}
    for d in order:
        if by_text.setdefault(texts[d], d) != d:
            shared.add((by_text[texts[d]], d))
    for a, b in shared:
        both = sum((bags[a] & bags[b]).values())
        if texts[a] == texts[b] or both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.doc_id: r.class_id for r in queries.op6_bag_minhash(spark, SF).collect()}
    assert got == {d: root(d) for d in order} and len(set(got.values())) < len(order)


def test_bag_counts_repeats(spark):
    """Equal sets of shingles, but different multisets, are no near duplicates."""
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(1, line), (2, " ".join([line] * 4)), (3, " ".join([line] * 4) + " x")]
    out = {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 1, 2: 2, 3: 2}


@pytest.mark.parametrize("order,bucket", [(2, 10**6), (3, 5000)])
def test_backoff_scores_equal_brute_force(docs, texts, order, bucket):
    some = docs.filter("doc_id < 200").repartition(3)
    got = {r.doc_id: r for r in backoff_lm.score_documents(some, order=order, bucket_grams=bucket).collect()}
    said = {d: words(t) for d, t in texts.items() if d < 200}
    own = {d: [collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) for k in range(order + 1)] for d, w in said.items()}
    counts = [sum((o[k] for o in own.values()), collections.Counter()) for k in range(order + 1)]
    total = sum(map(len, said.values()))
    for d, w in said.items():
        score = 0.0
        for i in range(len(w)):
            most = min(order, i + 1)
            for k in range(most, 0, -1):
                gram = tuple(w[i - k + 1: i + 1])
                c = counts[k][gram] - own[d][k][gram]
                if c:
                    below = total - len(w) if k == 1 else counts[k - 1][gram[:-1]] - own[d][k - 1][gram[:-1]]
                    score += math.log10(c / below) + (most - k) * math.log10(0.4)
                    break
            else:
                score += math.log10(1 / (total - len(w))) + most * math.log10(0.4)
        assert got[d].n_words == len(w) and got[d].log10_score == pytest.approx(score, rel=1e-9)


def test_license_phrases_equal_brute_force(spark, texts):
    phrases = [(p.split(), label) for p, label in licenses.PHRASES]
    for r in queries.op8_license_templates(spark, SF).collect():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))
        hits = [(k, label) for p, label in phrases for k in range(len(w) - len(p) + 1) if w[k: k + len(p)] == p]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_templates_match_mandatory_wording_only():
    one = licenses.compile_template("x", "may be used <<beginOptional>>freely <<beginOptional>>and<<endOptional>><<endOptional>> by <<var;who;1-3>> only")
    match = lambda text: one.longest_match(np.array([tb.word_hash(w) for w in licenses.text_words(text)], np.uint64))
    assert match("May be used, by all of us only.") == 8 and match("may be used freely and by me only more") == 8
    assert match("may be used by only") == 0 and match("may be used by a b c d only") == 0 and match("may be used and by me only") == 0
    with pytest.raises(ValueError):
        licenses.compile_template("x", "may <<var;x;0-3>> be").first_pairs()


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(0)
    for _ in range(500):
        a = rng.integers(1, rng.integers(2, 5), rng.integers(1, 40)).tolist() + [0]
        assert suffix_groups.suffix_array(np.array(a)).tolist() == sorted(range(len(a)), key=lambda i: a[i:])


@pytest.mark.parametrize("max_group", [100_000, 1])
def test_repeats_equal_brute_force(docs, texts, max_group):
    """Once by suffix order, once by the way for anchors with very many contexts."""
    got = {r.doc_id: r for r in repeats.cut_repeats(docs, keep=["doc_id"], max_group=max_group, bucket_size=500).select("doc_id", "cut.*").collect()}
    seen = set()
    for d in sorted(texts):
        raw = texts[d].encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            window = raw[k: k + 100]
            if window in seen:
                gone[k: k + 100] = b"\1" * 100
            seen.add(window)
        r = got[d]
        assert bytes(r.kept) == bytes(b for b, g in zip(raw, gone) if not g) and r.n_removed == sum(gone) and r.n_bytes == len(raw)
        assert r.n_spans == sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))


def test_mix_equals_oracle_and_comes_near_targets(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = con.execute(queries.ORACLES["op10_mix_thresholds"]).df().sort_values("doc_id")[names].to_numpy()
    out = queries.op10_mix_thresholds(spark, SF)
    assert np.array_equal(out.toPandas().sort_values("doc_id")[names].to_numpy(), want)
    sums = out.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert sums.filter(F.abs(F.col("taken") - F.col("target")) > 2).count() == 0


def test_small_sources_stop_at_three_passes(spark):
    rows = [(i, "w " * 10, "a") for i in range(100)] + [(1000 + i, "w w", "b") for i in range(3)] + [(2000, "w " * 500, None)]
    out = mixing.mix_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    targets = {r.source_size: (r.target, sum(x.taken for x in out if x.source_size == r.source_size)) for r in out}
    # 1506 in all: "b" stops at 18, the other two share 1488 by 1 : 3.
    assert targets == {1000: (372.0, 372), 6: (18.0, 18), 500: (1116.0, 1116)}


def test_mix_plan_runs_no_python(spark, docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_equals_its_operators(spark):
    """Each stage's decisions, recomputed from the registered operators' results on that stage's input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, steps[-1], sf)
        steps.append(spark.createDataFrame(made.collect(), made.schema))
    kept = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    scores = quality.score(steps[0], quality.train(steps[0], spark.read.parquet(f"{sf}/labels.parquet")))
    assert kept[1] == {r.doc_id for r in scores.filter("score >= 0.3").collect()} < kept[0]
    classes = bag_minhash.near_duplicates(steps[1]).collect()
    assert kept[2] == {r.class_id for r in classes} and kept[2] < kept[1]
    cut = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in repeats.cut_repeats(steps[2]).select("doc_id", "cut.kept").collect()}
    assert cut == {r.doc_id: r.text for r in steps[3].collect()}
    leaks = decontaminate.find_leaks(steps[3], spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert kept[4] == {r.doc_id for r in leaks.filter("size(leaks) = 0").collect()}
    taken = {r.doc_id: r.taken for r in mixing.mix_sizes(steps[4]).filter("taken > 0").collect()}
    assert {r.doc_id: r.taken for r in steps[5].collect()} == taken
    assert sorted(corpus_pipeline.run(spark, sf).collect()) == sorted(steps[5].collect())
