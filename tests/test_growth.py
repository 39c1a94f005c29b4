"""What a query costs per row: shared steps stand once in its plan, patterns agree with their plain form."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rolecast.config import DEFAULT_PARITY
from rolecast.functions import money, text, urls
from rolecast.operators import resolve, score, shaping
from rolecast.plans import posting_queries

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_both_reaches_judge_one_read_of_the_postings(spark):
    plan = _plan(posting_queries.filter_reasons_by_reach(spark, SMALL))
    assert plan.count("Join Inner") == 2 and "Union" not in plan


@pytest.mark.parametrize("name", ["send_preconditions", "run_totals"])
def test_lookups_do_not_judge_the_postings_again(spark, name):
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 28))
    plan = _plan(posting_queries.QUERIES[name](spark, SMALL))
    assert len(re.findall(r"titulo fora da area", plan)) == 1


def test_any_of_finds_what_the_plain_alternation_finds():
    rng = random.Random(3)
    for _ in range(300):
        terms = list({"".join(rng.choice("ab c-") for _ in range(rng.randint(1, 5))).strip() or "a" for _ in range(rng.randint(1, 8))})
        plain = "|".join(re.escape(t) for t in terms)
        for _ in range(20):
            s = "".join(rng.choice("ab c-") for _ in range(rng.randint(0, 12)))
            assert bool(re.search(text.phrase_pattern(terms), s)) == bool(re.search(plain, s))
            bounded = rf"(^|[^a-z0-9])({plain})(s|es|is)?([^a-z0-9]|$)"
            assert bool(re.search(text.word_pattern(terms), s)) == bool(re.search(bounded, s))


def test_collapse_of_every_kind_of_space(spark):
    cases = ["", " ", "a b", " a  b ", "a\tb", "a\nb\r\n", "\x0ba\fb", "a b", "a  b　", "á b", "a﻿b", None]
    got = spark.createDataFrame([(c,) for c in cases], "s string").select(
        "s", text.collapse(F.col("s")).alias("x"), F.trim(F.regexp_replace("s", text.SPACE + "+", " ")).alias("y")).collect()
    assert all(r.x == r.y for r in got)


def test_salary_patterns_give_the_same_amounts(spark):
    pay = money.salary_from_text(F.col("s"))
    rows = spark.createDataFrame(
        [("Faixa: R$ 5.123 por mes, vale 900",), ("salario de US$ 100k ao ano",), ("R$ 4.000 a R$ 6.500 mensal",), ("wr$ 5000 por mes",),
         ("R$ 10 por hora",), ("€ 3.000 - 4.000\npor ano",), ("Senior. r$ 7000/mes e r$ 9000 por ano",)], "s string")
    got = [(r.x and (r.x.de, r.x.ate, r.x.moeda, r.x.periodo)) for r in rows.select(pay.alias("x")).collect()]
    assert got == [(5123.0, None, "BRL", "mes"), (100000.0, None, "USD", "ano"), (4000.0, 6500.0, "BRL", "mes"), None,
                   None, (3000.0, 4000.0, "EUR", "ano"), (7000.0, None, "BRL", "mes")]


def test_clusters_read_written_keys(spark, monkeypatch):
    seen = []
    edges = resolve.identity_edges
    monkeypatch.setattr(resolve, "identity_edges", lambda keyed, *a: seen.append(_plan(keyed)) or edges(keyed, *a))
    posting_queries.entity_clusters(spark, SMALL)
    assert len(seen) == 1 and "Join" not in seen[0] and "Generate" not in seen[0]


def test_bound_columns_are_computed_outside_the_generator(spark):
    """A generator with a lambda in it is interpreted as a whole."""
    df = shaping.bind(spark.range(3), x=text.collapse(F.col("id").cast("string")))
    generators = re.findall(r"Generate .*", df._jdf.queryExecution().executedPlan().toString())
    assert len(generators) == 1 and "transform" not in generators[0]
    assert [r.x for r in df.collect()] == ["0", "1", "2"]


def test_usual_texts_and_links_need_no_lambda(spark):
    """The usual branch stands beside the lambda, not inside it."""
    for c in (text.normalize_text(F.col("s")), urls.normalize_link(F.col("s")), text.reads_english(F.col("s"))):
        plan = spark.createDataFrame([("a",)], "s string").select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.index("case when") < plan.index("transform(")


def test_plain_links_agree_with_their_parts(spark):
    rng = random.Random(5)
    bits = ["ref", "ref=1", "REF=", "refs=2", "utm_x", "UTM_y=3", "a", "a=1", "b=", "", "", "source=z/", "gh_jid=4", "x=%20", "lang", "é", "q?r", "www.", "#f"]
    cases = ["", "  ", "x", "http://", "HTTP://WWW.A.com", "http://www./", "http://www.www.a.com//", "http://a:80/b/", "http://u@a/b//?c"]
    for _ in range(3000):
        host = rng.choice(["a.com", "www.A.com", "WWW.b-c.io", "www.", "a.com:8", "u@a.com", "a_b"])
        path = "".join(rng.choice(["/", "/", "a", "Job", "1", "&ref=1", "%20", ".", "é", "[x]", "\\\\"]) for _ in range(rng.randint(0, 6)))
        query = "&".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))
        cases.append(f"{rng.choice(['http', 'https', 'x+y'])}://{host}/{path}".rstrip("/" if rng.random() < 0.2 else " ") + (f"?{query}" if rng.random() < 0.8 else ""))
    rows = spark.createDataFrame([(c,) for c in cases], "s string")
    u = F.trim("s")
    got = rows.select("s", urls.normalize_link(F.col("s")).alias("x"), urls._link_by_parts(u, DEFAULT_PARITY).alias("y"),
                      u.rlike(urls._PLAIN_LINK).alias("plain")).collect()
    assert [r for r in got if r.x != r.y] == []
    assert sum(r.plain for r in got) > 300


def test_comparable_title_agrees_with_all_steps(spark):
    rng = random.Random(6)
    bits = ["senior", "ref", "ref. 12", "(x)", "(", ")", "-", "–", "remoto", "remote", "home office", "work from home", "trabalho", "brasil", "latam", "pessoa",
            "designer de produto", "ux", "ui", "/", "ux/ui", "uiux", "12", "designer", "é", "  ", "a"]
    cases = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 7))) for _ in range(3000)]

    def every_step(s):
        for pattern, by in ((r"\([^)]*\)", " "), (r"\bref\.?\s*#?\s*[0-9a-z]+\b", " "),
                            (r"[|–—-]\s*(remoto|remote|home office|brasil|brazil|latam)\b.*$", " "),
                            (r"\b(remoto|remote|home office|trabalho remoto|work from home)\b", " "), (r"\bpessoa\b", " "),
                            (r"\bdesigner de produto\b", "product designer"), (r"\bux\s*/?\s*ui\b", "uiux"), (r"\bui\s*/?\s*ux\b", "uiux"),
                            (r"\bsenior\b", "sr"), (r"[^a-z0-9 ]+", " "), (" +", " ")):
            s = F.regexp_replace(s, pattern, by)
        return F.trim(s)

    got = spark.createDataFrame([(c,) for c in cases], "s string").select(
        "s", urls.comparable_title(F.col("s"), normalized=True).alias("x"), every_step(F.col("s")).alias("y")).collect()
    assert [r for r in got if r.x != r.y] == []


def test_whole_numbers_and_signals_as_before(spark):
    rows = [("5.123", 5123.0), ("12.000", 12000.0), ("12,000", 12000.0), ("1.234,567", 1234.567), ("1,234.5", 1234.5), ("12.5", 12.5), ("18k", 18000.0),
            ("1500", 1500.0), ("1234.567", 1234567.0), ("0.500", 500.0), ("", None), ("abc", None), ("5.123\n", 5123.0)]
    got = spark.createDataFrame(rows, "s string, want double").select("want", money.parse_number(F.col("s")).alias("x")).collect()
    assert [r.x for r in got] == [r.want for r in got]
    bodies = [("uma fintech", 10), ("banco de horas", 3), ("banco de horas em banco", 10), ("saas b2b", 7), ("banco de dados, saas", 7), ("", 3), ("bancos", 10)]
    got = spark.createDataFrame(bodies, "s string, want int").select(
        "want", score.domain_points(F.col("s")).alias("x"), score.signals_found(F.lit("ai research com figma")).alias("g"), score.signals_found(F.lit("nada")).alias("n")).collect()
    assert [r.x for r in got] == [r.want for r in got] and got[0].g == ["research", "figma", "ai"] and got[0].n == []


def test_costly_texts_are_computed_once(spark):
    costly = F.regexp_replace("s", "x+", "y")
    for f in (text.normalize_text, urls.normalize_link, urls.requisition, text.reads_english):
        plan = spark.createDataFrame([("a",)], "s string").select(f(costly).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("x+") == 1
