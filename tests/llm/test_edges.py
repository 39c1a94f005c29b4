"""Every operator on awkward tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolecast.llm import (
    adaptive_scan, backoff_lm, bag_minhash, chat_windows, decontaminate, html_main, licenses, mixing, quality, repeats,
)

CLASHING = ("_doc string, _text string, _h int, _node string, _key string, size string, score string, taken string, cut string, "
            "leaks string, scan string, label string, h string, rank string, _src string, doc string, copy string, at string")
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed, n=60):
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3)) % len(WORDS)] + str((seed + i) % 17) for i in range(n))


TEXTS = [
    (1, sentence(1)), (2, sentence(1)), (3, None), (4, ""), (5, "   \n\n\t "), (None, sentence(2)), (None, None), (6, "x"),
    (7, "\u0000� é ß 漢字 \U0001f600 " * 3), (8, sentence(4, 9000) + "\n" * 50), (8, sentence(5)), (8, sentence(5)),
    (9, "a" * 5000), (10, ("same line again\n" * 300)), (2, sentence(1)),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ["x"] * 2 + [1] + ["x"] * (CLASHING.count(",") - 2)
    rows = [(i, t, None if n % 3 == 0 else "en", [None, "a", "b"][n % 3], len(t or ""), *extra) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def ids(df, name="doc_id"):
    return sorted((r[0] is None, r[0] or 0) for r in df.select(name).collect())


def test_quality_scores_every_row(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (8, 0), (9, 0), (10, None), (None, 1), (99, 0), (1, 0)], "doc_id bigint, quality int")
    field = quality.train(docs, labels)
    out = quality.score(docs, field)
    assert ids(out) == ids(docs) and out.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert out.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.score(none, field).count() == 0
    assert quality.train(none, labels).constant == 1.0 and quality.train(docs, labels.limit(0)).constant == 1.0
    assert quality.train(docs, labels.filter("quality = 0 AND doc_id < 20")).constant == 0.0


def test_mix_of_awkward_rows(docs, none):
    out = mixing.mix_sizes(docs)
    assert ids(out) == ids(docs) and out.filter("taken > 3 * size OR taken < 0 OR taken IS NULL").count() == 0
    kept = mixing.mix(docs)
    assert kept.columns == [c for c in docs.columns if c != "taken"] + ["taken"] and kept.filter("taken <= 0").count() == 0
    assert mixing.mix_sizes(none).count() == 0 and mixing.mix(none).count() == 0


def test_near_duplicates_of_awkward_rows(docs, none):
    out = bag_minhash.near_duplicates(docs)
    assert ids(out) == ids(docs)
    got = {r.doc_id: r.class_id for r in out.filter("doc_id IN (1, 2, 3, 4)").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
    kept = bag_minhash.drop_near_duplicates(docs)
    # One row per different text here, since no two of them are similar.
    assert kept.columns == docs.columns and kept.count() == len({t or "" for _, t in TEXTS})
    assert bag_minhash.near_duplicates(none).count() == 0 and bag_minhash.drop_near_duplicates(none).count() == 0


def test_repeats_of_awkward_rows(docs, none):
    out = repeats.cut_repeats(docs)
    assert out.columns == [c for c in docs.columns if c != "cut"] + ["cut"] and ids(out) == ids(docs)
    whole = out.filter("cut.n_bytes >= 100 AND cut.n_bytes = cut.n_removed").groupBy("doc_id").count()
    # Copies of document 1, and one of the two equal rows 8.
    assert {r.doc_id: r["count"] for r in whole.collect()} == {2: 2, 8: 1}
    assert repeats.cut_repeats(none).count() == 0


def test_repeats_among_very_many_rows_of_one_key(spark):
    """More rows without a key than 18 bits number; each text stands twice."""
    rows = spark.range(270_000).select(
        F.lit(None).cast("bigint").alias("doc_id"), F.sha2(F.expr("string(id div 2)"), 512).alias("text"))
    out = repeats.cut_repeats(rows).groupBy("text").agg(
        F.count("*").alias("n"), F.sum("cut.n_removed").alias("removed"), F.max("cut.n_removed").alias("most"))
    assert out.groupBy("n", "removed", "most").count().collect() == [(2, 128, 128, 135_000)]


def test_leaks_of_awkward_rows(spark, docs, none):
    items = spark.createDataFrame(
        [(1, sentence(5, 40), "x"), (1, sentence(5, 40), "x"), (2, None, "x"), (3, "", "x"), (None, sentence(2, 30), "x"), (4, "of the", "x")],
        "item_id bigint, text string, leaks string")
    out = decontaminate.find_leaks(docs, items)
    assert ids(out) == ids(docs) and out.columns == [c for c in docs.columns if c != "leaks"] + ["leaks"]
    found = out.select("doc_id", F.explode("leaks.item").alias("item")).collect()
    assert sorted((r.doc_id or -1, r.item or -1) for r in found) == [(-1, -1)] + [(8, 1)] * 4
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).filter("size(leaks) > 0").count() == 0


def test_licenses_of_awkward_rows(docs, none):
    out = licenses.scan(docs)
    assert ids(out) == ids(docs) and out.columns == [c for c in docs.columns if c != "scan"] + ["scan"]
    assert out.filter("text IS NULL").select("scan.n_words").distinct().collect()[0][0] == 0
    assert licenses.scan(none).count() == 0


def test_scores_of_awkward_rows(docs, none):
    out = backoff_lm.score_documents(docs)
    assert ids(out) == ids(docs)
    assert out.filter("n_words = 0").select("log10_score", "per_word").distinct().collect() == [(0.0, None)]
    assert backoff_lm.score_documents(none).count() == 0


def test_chats_of_awkward_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, segment string, new string, _c string, system string"
    rows = [(None, 1, "user", "a"), (None, None, None, None), (1, 1, "system", "s"), (1, 1, "system", "s"), (2, 5, "assistant", "w " * 5000),
            (2, 5, "assistant", "w " * 5000), (2, 6, "user", "<turn:user>\\")]
    turns = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema)
    out = {r.conv_id: r for r in chat_windows.read_back(chat_windows.windows(turns)).collect()}
    assert {c: r.n_turns for c, r in out.items()} == {None: 2, 1: 2, 2: 3}
    assert out[2].loss_chars == 20000 and out[1].loss_chars == 0
    assert chat_windows.windows(turns.limit(0)).count() == 0


def test_pages_of_awkward_rows(spark):
    schema = "page_id bigint, url string, html string, _html string, _key string, _gone string, main_text string, text string"
    rows = [(1, None, None), (2, "no url", ""), (2, "http://h/", "<p>a <b>b\n c<p>d &amp; &lt;e"), (None, "http://h/", "<" * 2000),
            (3, "http://h/", "<div>" * 3000 + "deep"), (4, "HTTP://U@H:80/x", "<ARTICLE><P CLASS=x>q</ARTICLE><script>no"), (2, "no url", "")]
    pages = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], schema)
    out = html_main.extract(pages)
    assert out.columns == [c for c in pages.columns if c != "main_text"] + ["main_text"] and ids(out, "page_id") == ids(pages, "page_id")
    texts = {(r.page_id, r.url): r.main_text for r in out.collect()}
    assert texts[1, None] == "" and texts[2, "http://h/"] == "a b c\nd & <e" and texts[3, "http://h/"] == "deep"
    assert texts[4, "HTTP://U@H:80/x"] == "q" and texts[None, "http://h/"] == "<" * 2000
    assert html_main.extract(pages.limit(0)).count() == 0


def test_vectors_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [1.0]), (8, [1.0, None]), (None, [1.0, 0.0]), (9, [0.0, 1.0]), (50, [0.0, 2.0]), (100, [])]
    frame = spark.createDataFrame([(i, v, "x", "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, list string, _v string, rank int")
    out = adaptive_scan.search(frame, lambda key: F.pmod(key, F.lit(50)) == 0)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == {0: [(1, 1, 1.0), (2, 2, 1.0), (3, 2, 1.0), (4, 9, 0.0), (5, 50, 0.0)],
                   50: [(1, 9, 1.0), (2, 0, 0.0), (3, 1, 0.0), (4, 2, 0.0), (5, 2, 0.0)]}
    assert adaptive_scan.search(frame.limit(0), lambda key: key == 0).count() == 0


def test_vectors_of_any_size_length_and_repeated_queries(spark):
    rows = [(0, [1e200, 1.0]), (0, [1e200, 1.0]), (1, [3 * 2.0**660, 4 * 2.0**660]), (2, [3 * 2.0**-660, 4 * 2.0**-660]), (3, [5e-324, 0.0]), (50, [0.0, -1e308]), (50, [1.0, 0.0]),
            (100, [1.0, 0.0, 0.0]), (4, [0.0, 3.0, 4.0]), (5, [3.0, 0.0, 4.0]), (150, [2.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in adaptive_scan.search(frame, lambda key: F.pmod(key, F.lit(50)) == 0).collect()]
    assert sorted(g for g in got if g[0] == 0) == [(0, 1, 3, 1.0), (0, 2, 50, 1.0), (0, 3, 1, 0.6), (0, 4, 2, 0.6), (0, 5, 50, 0.0)]
    # Two different vectors of one id are a query each; the cosine with [1e200, 1] is a little below zero.
    low, high = [(1, 3, 0.0), (2, 0, 0.0), (3, 0, 0.0), (4, 1, -0.8), (5, 2, -0.8)], [(1, 0, 1.0), (2, 0, 1.0), (3, 3, 1.0), (4, 1, 0.6), (5, 2, 0.6)]
    assert sorted(g[1:] for g in got if g[0] == 50) == sorted(low + high)
    assert sorted(g for g in got if g[0] == 100) == [(100, 1, 5, 0.6), (100, 2, 4, 0.0)] and not [g for g in got if g[0] == 150]


@pytest.mark.parametrize("number", range(5))
def test_stages_keep_columns_and_take_awkward_rows(spark, docs, none, number, tmp_path):
    spark.createDataFrame([(1, 1), (8, 0), (9, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, sentence(5, 40))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    _, stage = corpus_pipeline.STAGES[number]
    plain = docs.drop("taken")
    out = stage(spark, plain, str(tmp_path))
    assert out.columns == plain.columns + (["taken"] if number == 4 else []) and out.count() <= docs.count()
    assert stage(spark, none.drop("taken"), str(tmp_path)).count() == 0
