"""Filter, score, resolution, lookups, state, windows, coverage and checks."""

import datetime as dt
import random
from itertools import combinations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rolecast.config import Keywords, Profile
from rolecast.functions import register, text
from rolecast.operators import components, coverage, entities, filters, lookups, quality, resolve, score, state, views, windows

NOW = "2026-09-25 12:00:00"
POSTING = ("id_externo string, fonte string, titulo string, empresa string, descricao string, link string, modelo string, remoto boolean, "
           "publicada_em timestamp, prazo timestamp, encerrada boolean, cidade string, estado string, senioridade string, seq bigint")
DEFAULT = dict(
    id_externo="x:1", fonte="Gupy", titulo="Product Designer", empresa="Acme", descricao="Vaga para a plataforma.", link=None, modelo="remoto",
    remoto=True, publicada_em=dt.datetime(2026, 9, 23), prazo=None, encerrada=None, cidade=None, estado=None, senioridade=None, seq=0)


def postings(spark, *cases):
    rows = [{**DEFAULT, "id_externo": f"x:{i}", "seq": i, **c} for i, c in enumerate(cases)]
    names = [f.split()[0] for f in POSTING.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], POSTING)


def reasons(spark, *cases, **kw):
    df = filters.with_reason(postings(spark, *cases), NOW, **kw)
    return [r.reason for r in df.orderBy("seq").select("reason").collect()]


def test_filter_reasons_in_order(spark):
    got = reasons(
        spark, {}, {"titulo": " "}, {"titulo": "Designer Gráfico"}, {"titulo": "Software Engineer, Design Systems"}, {"titulo": "Analista"},
        {"descricao": "Mantemos um banco de talentos ativo"}, {"descricao": "x" * 500 + " banco de talentos"}, {"empresa": "V4 Company Sul"},
        {"descricao": "Somos uma assessoria de marketing"}, {"titulo": "Product Designer Jr"}, {"descricao": "Bolsa de R$ 2.000/mês"},
        {"descricao": "Salário R$ 3.000 a combinar"}, {"encerrada": True}, {"modelo": "hibrido"}, {"modelo": None, "remoto": None},
        {"titulo": "Product Designer | Presencial", "modelo": None, "remoto": None}, {"descricao": "Modalidade: Presencial (Maceió)", "modelo": None, "remoto": None},
        {"prazo": dt.datetime(2026, 9, 1)}, {"publicada_em": dt.datetime(2026, 6, 1)}, {"publicada_em": None},
        {"publicada_em": dt.datetime(2026, 6, 1), "prazo": dt.datetime(2026, 10, 1)})
    assert got == [
        None, "sem titulo", "titulo excluido: grafico", "outra disciplina: software engineer", "titulo fora da area",
        "nao e vaga aberta: banco de talentos", None, "empregador de outra disciplina: v4 company", "vaga de marketing: assessoria de marketing",
        "senioridade: junior", "salario abaixo do piso: R$ 2k (~R$ 2000/mes)", None, "inscricoes encerradas",
        "conflito de modalidade: hibrido: so remoto entra", None, "presencial: so remoto entra", "presencial: so remoto entra", "prazo vencido",
        "zumbi: mais de 30 dias sem sinal de vida", None, None]


def test_accepted_models_need_the_city(spark):
    p = Profile(accepts_hybrid=True, city="Recife")
    got = reasons(spark, {"modelo": "hibrido", "cidade": "Recife"}, {"modelo": "hibrido", "cidade": "Natal"}, {"modelo": "presencial", "remoto": None}, profile=p)
    assert got == [None, "hibrido fora de Recife", "presencial: so remoto entra"]
    assert reasons(spark, {"modelo": None, "remoto": None}, profile=Profile(unknown_model_passes=False)) == ["modelo de trabalho desconhecido"]


def test_filter_without_a_list_drops_nothing_by_it(spark):
    kw = Keywords(title_excluded=(), role_excluded=(), talent_pool=(), employer_excluded=(), marketing_framing=())
    assert reasons(spark, {"titulo": "Designer Gráfico"}, kw=kw) == [None]


def test_eligibility(spark):
    df = spark.createDataFrame(
        [(0, ["Worldwide"], ""), (1, ["San Francisco, CA"], "offices in Brazil"), (2, ["Remote"], "Location: Remote, LATAM only"),
         (3, [], "We have an office. Brazil team."), (4, ["Remote", "Brazil"], None)], "i int, r array<string>, d string")
    got = df.select("i", filters.eligibility(F.col("r"), F.col("d")).alias("e")).orderBy("i").collect()
    assert [(r.e.entra, r.e.latam) for r in got] == [(True, True), (False, False), (True, True), (True, None), (True, True)]


def scored(spark, *cases, profile=Profile()):
    df = score.with_score(filters.with_features(postings(spark, *cases), NOW, profile), profile)
    return [r.score for r in df.orderBy("seq").select("score").collect()]


def test_score_parts(spark):
    body = "Fintech com design system, design systems, discovery, pesquisa, research, IA e inteligência artificial; inglês fluente"
    a, b, c = scored(
        spark, {"titulo": "Senior Product Designer", "descricao": body}, {"titulo": "Designer", "descricao": "banco de horas e seguros de vida como benefício"},
        {"titulo": "Product Designer Pleno", "descricao": "R$ 15.000 por mês"})
    assert (a.parcelas.titulo, a.parcelas.senioridade, a.parcelas.dominio, a.parcelas.frescor) == (20, 10, 10, 5)
    assert list(a.sinais_achados) == ["design system", "discovery", "research", "ia"] and a.ingles == "forte"
    assert a.determinado == 20 + 10 + 10 + 6 + 5 - 4
    assert b.parcelas.dominio == 3 and b.parcelas.titulo == 4
    assert c.parcelas.senioridade == 10


def test_market_discount(spark):
    p = Profile(market_focus="ambos", market_priority="internacional")
    assert scored(spark, {}, profile=p)[0].desconto_mercado == 6
    assert scored(spark, {})[0].desconto_mercado == 0


def test_compatibility_and_band(spark):
    df = spark.createDataFrame(
        [(50.5, 40.0, True, "Gupy"), (50.0, None, None, "Gupy"), (58.0, 99.0, False, "Gupy"), (58.0, 40.0, True, "Solta"), (10.0, -5.0, True, "x")],
        "d double, s double, v boolean, f string")
    got = [tuple(r) for r in df.select(score.compatibility(F.col("d"), F.col("s"), F.col("v"), F.col("f")).alias("c")).withColumn(
        "b", score.band(F.col("c"))).collect()]
    assert got == [(91, "Aplicar ja"), (50, "Radar"), (55, "Vale olhar"), (60, "Vale olhar"), (10, "Fora")]


def test_active_sources(spark):
    df = spark.createDataFrame([("Gupy",), ("Arc",), ("LinkedIn (Apify)",), ("InHire",)], "fonte string")
    names = lambda p: {r.fonte for r in filters.active_sources(df, p).collect()}
    assert names(Profile(market_focus="nacional", sources_off=("InHire",))) == {"Gupy", "LinkedIn (Apify)"}
    assert names(Profile(market_focus="internacional")) == {"Arc", "LinkedIn (Apify)"}


# ------------------------------------------------------------------------- resolution


def brute_components(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    members = [(f"n{rng.randrange(120):03d}", f"k{rng.randrange(70)}") for _ in range(160)]
    members += [(f"c{i:03d}", f"chain{i}") for i in range(40)] + [(f"c{i + 1:03d}", f"chain{i}") for i in range(40)]
    by_key = {}
    for n, k in members:
        by_key.setdefault(k, set()).add(n)
    want = brute_components([p for ns in by_key.values() for p in combinations(sorted(ns), 2)])
    df = spark.createDataFrame(members, "node string, key string")
    got = {r.node: r.label for r in components.component_labels(components.star_edges(df, "node", "key")).collect()}
    assert got == want


def test_one_hot_key_needs_no_pairs(spark):
    df = spark.range(3000).select(F.format_string("n%05d", "id").alias("node"), F.lit("hot").alias("key"))
    edges = components.star_edges(df, "node", "key")
    assert edges.count() == 2999
    assert components.component_labels(edges).select("label").distinct().count() == 1


UUID = "e2e3ecd3-1111-2222-3333-444455556666"
SAME = [
    dict(id_externo="remotar:1", fonte="Remotar", titulo="Designer Sr", empresa="MJV", link=f"https://mjv.inhire.app/vagas/{UUID}/designer-sr", descricao="texto", modelo=None),
    dict(id_externo=f"inhire:{UUID}", fonte="InHire", titulo="Designer Senior", empresa="MJV", link=f"https://mjv.inhire.app/vagas/{UUID}", descricao=None, modelo="remoto"),
    dict(id_externo="li:1", fonte="LinkedIn (Apify)", titulo="(1552) Senior UX/UI", empresa="Nortal", link="https://l.com/1"),
    dict(id_externo="li:2", fonte="Arc", titulo="Senior UX/UI (1552)", empresa="Nortal", link="https://arc.dev/2"),
    dict(id_externo="li:3", fonte="Arc", titulo="(1520) Senior UX/UI", empresa="Nortal", link="https://arc.dev/3"),
    dict(id_externo="a:1", fonte="Arc", titulo="Product Designer", empresa="alt.bank", link="https://a.com/1"),
    dict(id_externo="a:2", fonte="Arc", titulo="Product Designer - Remoto", empresa="alt.bank", link="https://a.com/2"),
    dict(id_externo="j:1", fonte="Arc", titulo="Product Designer", empresa="Jobgether", link="https://j.com/1"),
    dict(id_externo="j:2", fonte="Arc", titulo="Product Designer", empresa="Jobgether", link="https://j.com/2"),
]


def test_resolve_merges_strong_and_flags_weak(spark):
    got = resolve.resolve(postings(spark, *SAME))
    survivors = {r.id_externo: r for r in got.survivors.collect()}
    assert set(survivors) == {f"inhire:{UUID}", "li:2", "li:3", "a:1", "a:2", "j:1", "j:2"}
    kept = survivors[f"inhire:{UUID}"]
    assert kept.descricao == "texto" and kept.tambem_visto_em == ["Remotar"] and kept.n_fundidas == 1
    assert {tuple(r) for r in got.aliases.collect()} == {(f"inhire:{UUID}", "remotar:1"), ("li:2", "li:1")}
    assert {tuple(r) for r in got.possible_duplicates.collect()} == {("a:1", "a:2"), ("a:2", "a:1")}
    assert resolve.collisions(got).first()[0] == 2


def test_loose_mode_merges_weak_but_not_intermediaries(spark):
    ids = {r.id_externo for r in resolve.resolve(postings(spark, *SAME), strict=False).survivors.collect()}
    assert "a:2" not in ids and {"j:1", "j:2", "li:2", "li:3"} <= ids


def test_resolution_does_not_depend_on_order_or_partitions(spark):
    base = {r.id_externo: r.cluster for r in resolve.resolve(postings(spark, *SAME)).survivors.collect()}
    shuffled = postings(spark, *SAME).repartition(7, "titulo").orderBy(F.desc("link"))
    assert {r.id_externo: r.cluster for r in resolve.resolve(shuffled).survivors.collect()} == base


def test_duplicate_rows_of_one_id_become_one(spark):
    df = postings(spark, dict(id_externo="z:1", link="https://z.com/1"), dict(id_externo="z:1", link="https://z.com/other"))
    assert resolve.resolve(df).survivors.count() == 1


def test_alias_conflicts_are_reported(spark):
    df = spark.createDataFrame([("c1", "a1"), ("c1", "a2"), ("c2", "a3"), ("c3", "a4"), ("c4", "a4")], "canonico string, alias string")
    ok, bad = resolve.resolve_aliases(df)
    assert {tuple(r) for r in ok.collect()} == {("a1", "c1"), ("a2", "c1"), ("a3", "c2")}
    assert {tuple(r) for r in bad.collect()} == {("a4", 2)}


# ---------------------------------------------------------------------------- lookups


def test_judgement_priority_and_staleness(spark):
    df = postings(spark, dict(id_externo="n:1", descricao="texto novo"), dict(id_externo="n:2"), dict(id_externo="n:3")).withColumn(
        "id_canonico", F.when(F.col("id_externo") == "n:1", "old:1").otherwise(F.col("id_externo")))
    aliases = spark.createDataFrame([("n:2", "older:2")], "id_externo string, alias string")
    j = spark.createDataFrame([("old:1", 30.0, "r", None, "aaaaaaaaaaaa", None), ("older:2", 20.0, None, None, None, None)],
                              "id string, nota double, resumo string, gaps string, impressao string, lido_em date")
    joined = lookups.join_judgements(df, j, aliases)
    got = {r.id_externo: (r.semantico, r.lida, r.julgamento_veio_de, r.julgamento_desatualizado) for r in joined.collect()}
    assert got == {"n:1": (30.0, True, "old:1", True), "n:2": (20.0, True, "older:2", False), "n:3": (None, False, None, None)}
    moved = {r.id: r.nota for r in lookups.migrate_judgement_keys(j, joined).collect()}
    assert moved == {"n:1": 30.0, "n:2": 20.0}


def test_board_lookup_order(spark):
    board = spark.createDataFrame(
        [("b:id", "Entrevista", None, None, None, 1), ("m:1", "Aplicar", None, None, "https://www.l.com/1/?utm_source=q", 2),
         ("m:2", "Já apliquei", "(1552) X", "Nortal", None, 3), ("m:3", "Avaliar", "Product Designer", "alt.bank", None, 4),
         ("m:4", "Cancelada", "(1520) Senior UX", "Beta", None, 5)],
        "id string, status string, titulo string, empresa string, url string, ord int")
    df = postings(
        spark, dict(id_externo="b:id"), dict(id_externo="p:1", link="https://l.com/1"), dict(id_externo="p:2", titulo="Outro (1552)", empresa="Nortal"),
        dict(id_externo="p:3", titulo="Product Designer - Remoto", empresa="alt.bank"), dict(id_externo="p:4", titulo="(1552) Senior UX", empresa="Beta"))
    strict = {r.id_externo: (r.status_notion, r.concluida, r.conflito_identidade, r.possivel_duplicata_quadro) for r in lookups.join_board(df, board).collect()}
    assert strict == {
        "b:id": ("Entrevista", True, False, None), "p:1": ("Aplicar", False, False, None), "p:2": ("Já apliquei", True, False, None),
        "p:3": (None, False, True, "Avaliar"), "p:4": (None, False, False, None)}
    loose = {r.id_externo: r.status_notion for r in lookups.join_board(df, board, strict=False).collect()}
    assert loose["p:3"] == "Avaliar" and loose["p:4"] is None


def test_classify_urls(spark):
    u = spark.createDataFrame([("https://boards.greenhouse.io/a/jobs/1",), ("https://boards.greenhouse.io/a/jobs/2",), ("https://boards.greenhouse.io/a/jobs/3",),
                               ("https://boards.greenhouse.io/a/jobs/4",), ("https://boards.greenhouse.io/a/jobs/5",), ("https://x.com",)], "url string")
    cache = spark.createDataFrame([("greenhouse:1",)], "id_externo string")
    pages = spark.createDataFrame([
        ("https://boards.greenhouse.io/a/jobs/2", '"status":"frozen" <title>Product Designer</title>'), ("https://boards.greenhouse.io/a/jobs/3", "<title>Contador</title>"),
        ("https://boards.greenhouse.io/a/jobs/4", "<title>Product Designer</title>")], "url string, html string")
    got = {r.url[-1]: r.classe for r in lookups.classify_urls(u, cache, pages, NOW).collect()}
    assert got == {"1": "ja_no_cache", "2": "morta", "3": "reprovada", "4": "nova", "5": "nao_verificada", "m": "sem_id"}


def test_project_effects(spark):
    tasks = spark.createDataFrame([("t1", "c1", ["a1"], "pronta"), ("t2", "c2", [], "pronta"), ("t3", "c3", None, "pronta")],
                                  "chave string, canonico string, aliases array<string>, estado string")
    att = spark.createDataFrame([("a1", [], "confirmado"), ("c1", [], None), ("t2", ["z"], "confirmado")], "chave string, aliases array<string>, desfecho string")
    assert {r.chave: r.estado for r in lookups.project_effects(tasks, att).collect()} == {"t1": "envio_incerto", "t2": "enviada", "t3": "pronta"}


# ------------------------------------------------------------------------------ state


def test_cache_upsert_is_idempotent(spark):
    old = postings(spark, dict(id_externo="a", titulo="old", senioridade="senior"), dict(id_externo="b")).withColumn(
        "encontrada_em", F.lit("2026-01-01").cast("timestamp"))
    new = postings(spark, dict(id_externo="a", titulo="new"), dict(id_externo="c"))
    once = state.upsert_cache(old, new, NOW, sparse=("senioridade",))
    got = {r.id_externo: (r.titulo, r.senioridade, r.encontrada_em.year, r.encontrada_em.month) for r in once.collect()}
    assert got == {"a": ("new", "senior", 2026, 1), "b": ("Product Designer", None, 2026, 1), "c": ("Product Designer", None, 2026, 9)}
    again = {r.id_externo: (r.titulo, r.senioridade, r.encontrada_em.year, r.encontrada_em.month) for r in state.upsert_cache(once, new, NOW, sparse=("senioridade",)).collect()}
    assert again == got


BOARD = ("id string, status string, titulo string, empresa string, url string, fonte string, compatibilidade int, salario_texto string, "
         "publicada_em timestamp, registrada_em timestamp")


def test_register_is_idempotent_and_keeps_status(spark):
    board = spark.createDataFrame([("a", "Aplicar", "old", "E", "u", None, 1, None, None, None)], BOARD)
    df = postings(spark, dict(id_externo="a", titulo="new", link=None), dict(id_externo="b"))
    nxt, events = state.register(board, df, NOW)
    got = {r.id: (r.status, r.titulo, r.url) for r in nxt.collect()}
    assert got == {"a": ("Aplicar", "new", "u"), "b": ("Avaliar", "Product Designer", None)}
    assert [(r.id, r.para, r.por) for r in events.collect()] == [("b", "Avaliar", "rodada")]
    assert state.register(nxt, df, NOW)[1].count() == 0


def test_moves(spark):
    board = spark.createDataFrame([("a", "Avaliar"), ("b", "Avaliar")], "id string, status string")
    t = lambda m: dt.datetime(2026, 1, 1, 0, m)
    moves = spark.createDataFrame([
        ("a", "Aplicar", "p", t(1), 1), ("a", "Aplicar", "p", t(2), 2), ("a", "Entrevista", "p", t(3), 3), ("b", "Sumiu", "p", t(4), 4), ("z", "Aplicar", "p", t(5), 5)],
        "id string, para string, por string, em timestamp, seq bigint")
    nxt, events, rejected = state.apply_moves(board, moves)
    assert {tuple(r) for r in nxt.collect()} == {("a", "Entrevista"), ("b", "Avaliar")}
    assert {(r.id, r.de, r.para) for r in events.collect()} == {("a", "Avaliar", "Aplicar"), ("a", "Aplicar", "Entrevista")}
    assert {r.motivo for r in rejected.collect()} == {"status desconhecido: Sumiu", "vaga nao esta no quadro: z"}


def test_judgement_upsert_clamps_and_keeps(spark):
    kind = "id string, nota double, resumo string, gaps string, impressao string, lido_em date"
    stored = spark.createDataFrame([("a", 10.0, "r", "g", "p", None), ("b", 5.0, None, None, None, None)], kind)
    new = spark.createDataFrame([("a", 99.0, None, "g2", None, "texto", None, 1), ("c", -3.0, None, None, None, None, None, 1)],
                                "id string, nota double, resumo string, gaps string, impressao string, descricao string, lido_em date, ord int")
    got = {r.id: (r.nota, r.resumo, r.gaps, str(r.lido_em)) for r in state.upsert_judgements(stored, new, "2026-09-25").collect()}
    assert got == {"a": (40.0, "r", "g2", "2026-09-25"), "b": (5.0, None, None, "None"), "c": (0.0, None, None, "2026-09-25")}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "id string, n int")
    assert state.backup_once(df, f"{tmp_path}/bk", "2026-09-25") is True
    assert state.backup_once(df.limit(1), f"{tmp_path}/bk", "2026-09-25") is False
    assert state.backup_once(df, f"{tmp_path}/bk", "2026-09-26") is True
    assert spark.read.parquet(f"{tmp_path}/bk").count() == 4
    table = state.snapshot_table(spark, f"{tmp_path}/snap", df.schema, ["id"])
    assert state.replace_snapshot(table, df, "2026-09-25 10:00:00") is True
    assert state.replace_snapshot(table, df.limit(1), "2026-09-24 10:00:00") is False and table.read().count() == 2
    assert state.replace_snapshot(table, df.limit(1), "2026-09-25 10:00:00") is True and table.read().count() == 1
    with pytest.raises(PySparkException):
        state.replace_snapshot(table, df.withColumn("n", F.raise_error(F.lit("lost")).cast("int")), "2026-09-26 10:00:00")
    assert table.read().count() == 1 and table.facts() == {"consultado_em": "2026-09-25T10:00:00"}
    state.write_judgements(df, f"{tmp_path}/j")
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/j").coalesce(1).collect()] == ["a", "b"]
    state.write_run_report(df.agg(F.count("*").alias("n")), f"{tmp_path}/run", "2026-09-25")
    assert spark.read.json(f"{tmp_path}/run").first().n == 2


# ---------------------------------------------------------------------------- windows


def test_two_level_window_equals_plain_window(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randrange(400)), i, rng.randrange(9))
            for i in range(600)]
    df = spark.createDataFrame(data, "k string, ts timestamp, seq int, v int")
    prev = {r.seq: r.ant_v for r in windows.with_previous(df, "k", ["ts", "seq"], ["v"]).collect()}
    total = {r.seq: r.acumulado for r in windows.with_running_sum(df, "k", ["ts", "seq"], "v").collect()}
    seen, sums = {}, {}
    for k, _, seq, v in sorted(data, key=lambda r: (r[1], r[2])):
        assert prev[seq] == seen.get(k)
        sums[k] = sums.get(k, 0) + v
        assert total[seq] == sums[k]
        seen[k] = v


def test_first_per_key_cuts_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    got = windows.first_per_key(df, ["k"], F.desc("id"))
    assert {r.k: r.id for r in got.collect()} == {0: 99, 1: 97, 2: 98}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_revision_chain(spark):
    df = spark.createDataFrame([("t", 1, "e1", None), ("t", 2, "e2", "e1"), ("t", 3, "e3", "e1"), ("u", 2, "x", None)],
                               "task_id string, revisao int, entrega_id string, substitui_id string")
    assert {(r.task_id, r.revisao): r.ok for r in windows.revision_chain(df).collect()} == {("t", 1): True, ("t", 2): True, ("t", 3): False, ("u", 2): False}


# ------------------------------------------------------------------ coverage and checks


def test_bigrams_do_not_join_words_across_stops(spark):
    df = spark.createDataFrame([("ferramentas com foco, ferramentas com foco; design system e design system",)], "t string")
    got = df.select(coverage.bigrams(coverage.plain_words(F.col("t")), ("com",)).alias("b")).first().b
    assert got == ["foco ferramentas", "foco design", "design system", "design system"]
    counted = df.select(coverage.tally(coverage.bigrams(coverage.plain_words(F.col("t")), ("com",))).alias("c")).first().c
    assert {(x.term, x.n) for x in counted} == {("design system", 2), ("foco ferramentas", 1), ("foco design", 1)}


def test_coverage(spark):
    p = spark.createDataFrame([("v", "Discovery e pesquisa com figma. Fluxo novo, fluxo novo.", 1)], "id string, texto string, resume_id int")
    r = spark.createDataFrame([(1, "Fiz descoberta de produto e prototipo no Figma")], "resume_id int, texto string")
    got = {x.termo: (x.situacao, x.via) for x in coverage.coverage(
        p, r, (("discovery", "descoberta"), ("research", "pesquisa"), ("figma", "figjam"))).collect()}
    assert got == {"discovery": ("sinonimo", "descoberta"), "pesquisa": ("ausente", None), "figma": ("coberto", None), "fluxo novo": ("ausente", None)}


def test_coverage_keeps_all_terms_and_ranks_pairs_by_count(spark):
    terms = [f"termo{i:02d}" for i in range(40)]
    body = " . ".join(terms) + " . " + "raro par . " * 2 + "zona comum . " * 5
    p = spark.createDataFrame([("v", body, 1)], "id string, texto string, resume_id int")
    r = spark.createDataFrame([(1, "nada")], "resume_id int, texto string")
    groups = tuple((t, t + "x") for t in terms)
    whole = {x.termo for x in coverage.coverage(p, r, groups).collect()}
    assert set(terms) <= whole and {"raro par", "zona comum"} <= whole
    cut = {x.termo for x in coverage.coverage(p, r, groups, cap=1).collect()}
    assert set(terms) <= cut and "raro par" not in cut


def test_a_hot_key_is_cut_into_even_parts(spark):
    rows = [("hot" if i % 10 else f"k{i}", i, i % 3) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, seq int, v int").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the parts are tiny here
    try:
        sizes = [r["count"] for r in windows._in_parts(df, "k", ["seq"]).groupBy(windows._PART).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_emphasis_and_bullets(spark):
    themes = coverage.emphasis(postings(spark, dict(titulo="Product Designer", descricao="Design system, tokens e pesquisa em fintech")))
    assert {r.balde: r.n for r in themes.collect()} == {"design-system": 2, "research": 1, "fintech": 1}
    resume = spark.createDataFrame([("Acme", ["fez ds", "segredo ds", "outra"], [["design-system"], ["design-system"], ["mobile"]])],
                                   "empresa string, bullets array<string>, temas array<array<string>>")
    got = coverage.emphasised_bullets(themes, resume, never=("segredo",)).collect()
    assert [(r.balde, r.texto) for r in got] == [("design-system", "fez ds")]


def test_answer_bank(spark):
    df = spark.createDataFrame([
        (1, "P?", "pretensao", "R$ 10k", True, "direta", "geral", "perfil.json"), (2, "P?", "Pretensão", "ver data/x", True, "direta", "geral", "fonte"),
        (3, "", "", None, None, "outra", "", "")],
        "ord int, pergunta string, normalizada string, resposta string, aprovada boolean, uso string, escopo string, fonte string")
    got = {r.ord: (list(r.erros), list(r.avisos), r.pronta) for r in quality.check_answers(df).collect()}
    assert got[1] == ([], [], True)
    assert "resposta contém instrução ou resumo, não texto final" in got[2][0] and got[2][1] == ["chave equivalente já existe; conferir contexto antes de reutilizar"]
    assert len(got[3][0]) == 4


def test_send_preconditions_collect_all_reasons(spark):
    df = spark.createDataFrame([(True, "Aplicar", True, False, False, True), (True, "Avaliar", False, None, True, False)],
                               "presente boolean, status_quadro string, lida boolean, julgamento_desatualizado boolean, conflito_identidade boolean, transmissao boolean")
    a, b = quality.send_preconditions(df, NOW, authorised=True).collect()
    assert a.precondicoes_atendidas and len(b.motivos) == 4


def test_snapshot_is_all_or_nothing(spark):
    row = lambda p, i, s="Avaliar": (p, i, s, None, None, None, None)
    good = [("g", 0, None, "c1", True, [row("p1", "a")]), ("g", 1, "c1", None, False, [row("p2", "b")])]
    bad = [("b", 0, None, "c1", True, [row("p3", "a"), row("p3", "c", "Outro")]), ("b", 1, "cX", None, False, [row("p4", "a")])]
    kind = ("snapshot_id string, indice int, cursor_entrada string, proximo_cursor string, tem_mais boolean, vagas array<struct<pagina_id:string,"
            "id_externo:string,status:string,empresa:string,titulo:string,url:string,gaps:string>>")
    ok, violations = quality.validate_snapshot(spark.createDataFrame(good + bad, kind))
    assert {r.id_externo for r in ok.collect()} == {"a", "b"}
    assert {r.motivo for r in violations.collect()} == {"paginação incompleta", "status desconhecido", "idExterno duplicado", "paginaId duplicado"}


def test_import_completeness(spark):
    kind = "fonte string, offset int, limite int, total int, brutas int, invalidas int, duplicadas int, importadas int, erro string, desativada boolean"
    df = spark.createDataFrame([
        ("ok", 0, 10, 12, 10, 0, 0, 10, None, None), ("ok", 10, 10, 12, 2, 0, 0, 2, None, None), ("cut", 0, 10, None, 10, 0, 0, 10, None, None),
        ("empty", 0, 10, 0, 0, 0, 0, 0, None, None), ("bad", 0, 10, None, 0, 0, 0, 0, "HTTP 500", None), ("part", 0, 10, None, 10, 1, 0, 9, None, None),
        ("part", 10, 10, None, 0, 0, 0, 0, "x", None), ("off", 0, 10, None, 0, 0, 0, 0, None, True)], kind)
    got = {r.fonte: (r.status, r.truncada, r.completa) for r in quality.import_completeness(df).collect()}
    assert got == {"ok": ("ok", False, True), "cut": ("parcial", True, False), "empty": ("vazia", False, True), "bad": ("erro", False, False),
                   "part": ("parcial", True, False), "off": ("desativada", False, False)}


def test_facets_page_yield_and_balance(spark):
    f = spark.createDataFrame([("l", "pais", "a", 1500, 2000), ("l", "pais", "b", 900, 2000), ("l", "area", "x", 2000, 2000)],
                              "listagem string, faceta string, valor string, quantidade int, total_informado int")
    r = views.facet_coverage(f).first()
    assert (r.total_real, r.faceta_menor_fatia, r.truncada) == (2400, "pais", True)
    y = spark.createDataFrame([("a", "u", 6, 6, 2), ("b", "u", 3, 0, 0), ("c", "u", 6, 6, 5)], "fonte string, url string, cartoes int, usaveis int, com_local int")
    assert {r.fonte: r.layout_suspeito for r in views.page_yield(y).collect()} == {"a": True, "b": True, "c": False}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id_externo string")
    r = views.balance_check(ids("a"), ids("a", "b", "c"), F.lit("2026-09-23").cast("date"), F.lit("2026-09-25").cast("date"), start=25).first()
    assert (r.novas, r.quota_devida, r.saldo) == (2, 20, 7)


def test_sql_functions(spark):
    names = register.register(spark)
    assert len(names) == len(register.functions()) >= 75
    r = spark.sql("SELECT job_normalize_text('  Ação  X ') AS a, job_requisition('(1552) Y') AS b, job_is_alive('frozen') AS c, job_fingerprint(' a  b ') AS d").first()
    want = spark.range(1).select(text.fingerprint(F.lit("a b"))).first()[0]
    assert (r.a, r.b, r.c, r.d) == ("acao x", "1552", False, want)


def test_each_sql_function_equals_its_column(spark):
    texts = [
        None, "", "  Ação  X ", "Senior Designer at Acme (1552)", "Acme: Product Designer", "Vaga home office: UX na Acme - SP", "Remote · Chile, Brazil", "3 Locations",
        "R$ 8.000 a 12.000 por mes, ingles avançado", "R$8,100.00/mo - R$10,000.00/mo", "115K-130K Annually", "1.234,5", "2 weeks ago", "Posted 3 Days Ago",
        "Reposted 15 Days Ago", "Yesterday", "2026-08-25T10:00:00Z", "August 25, 2026", "Mar 5, 2026 6:28 PM", "Tue, 25 Aug 2026 10:00:00 GMT", "entry level",
        "hibrido, modelo presencial", "https://www.gupy.io/jobs/123?utm_source=x&f_WT=2#y", "https://acme.myworkdayjobs.com/x/Role_JR-1234-2", "acme-design-co",
        "<html><title>A &amp; B</title><script>x</script><p>Ol&aacute; it\'s</p>{\"status\": \"published\"} 2026-01-02T03:04</html>", "**bold** [a](b) \\ 'q'",
        "CPF 123.456.789-00 sk-abcdefghijklmnopqrst", "the and of with for " * 20, "1 YEAR", "nova", "USD", "\u0622\ud55c"]
    times = [None, dt.datetime(2026, 8, 25, 12), dt.datetime(2026, 1, 1)]
    pay = [None, (8000.0, None, "BRL", "texto", "mes"), (30.0, 50.0, "USD", "fonte", "hora")]
    sample = {"string": texts, "timestamp": times, "date": [None, dt.date(2026, 8, 1)], "int": [None, 0, 5, 12, 25, 99], "boolean": [None, True],
              "double": [None, 0.0, 100.0, 1.7e9, 1.7e12], "array<string>": [None, ["São Paulo", "são paulo", ""], ["Senior"]], register.PAY: pay}
    names, made = register.register(spark, "same_"), register.functions()
    rows = max(len(v) for v in sample.values())
    kinds = sorted({t for f in made.values() for t in f.arguments.values()} - {"variant"})
    # Two columns of each type, out of step with each other, so that functions of several arguments see several pairs.
    data = [(i, *[sample[t][(i * k + k - 1) % len(sample[t])] for t in kinds for k in (1, 2)]) for i in range(rows)]
    df = spark.createDataFrame(data, "i int, " + ", ".join(f"c{n}_{k} {t}" for n, t in enumerate(kinds) for k in (1, 2))).withColumn(
        "v", F.try_parse_json(F.lit('{"from": 10, "maxSalary": 20, "type": "month"}')))
    differ = []
    for name, f in made.items():
        seen, given = {}, []
        for t in f.arguments.values():
            seen[t] = seen.get(t, 0) + 1
            given.append("v" if t == "variant" else f"c{kinds.index(t)}_{1 + (seen[t] - 1) % 2}")
        differ.append((~F.expr(f"same_{name}({', '.join(given)})").eqNullSafe(f.expression(*[F.col(g) for g in given]))).alias(name))
    wrong = set()
    for at in range(0, len(differ), 15):
        wrong |= {n for r in df.select(*differ[at:at + 15]).collect() for n, d in r.asDict().items() if d}
    assert wrong == set() and len(names) == len(made) == len(differ)


def test_checkpoint_folder_comes_from_the_session(spark, tmp_path):
    from rolecast.operators import shaping
    assert shaping.scratch_path(spark, "x").startswith(shaping.checkpoint_root(spark))


def test_mapping_is_checked():
    from rolecast.sources import boards
    with pytest.raises(ValueError):
        boards.check_mapping({"title": "a"})
    with pytest.raises(ValueError):
        boards.check_mapping({**{k: None for k in boards.IMPORT_FIELDS}, "title": "__proto__;", "url": "u"})
    boards.check_mapping({**{k: None for k in boards.IMPORT_FIELDS}, "title": "a.b", "url": "u"})


def test_cache_of_parts(spark, tmp_path):
    kind = "id_externo string, titulo string, publicada_em timestamp"
    schema = spark.createDataFrame([], kind + ", encontrada_em timestamp").schema
    cache = state.cache_table(spark, f"{tmp_path}/c", schema, parts=8)
    state.save_cache(cache, spark.createDataFrame([(f"a{i}", "v1", None) for i in range(30)] + [(None, "x", None)], kind), "2026-09-25 00:00:00")
    touched = state.save_cache(cache, spark.createDataFrame([("a3", "v2", None)], kind), "2026-09-26 00:00:00")
    rows = {r.id_externo: (r.titulo, r.encontrada_em.day) for r in cache.read().collect()}
    assert len(touched) == 1 and len(rows) == 30 and rows["a3"] == ("v2", 25) and rows["a4"] == ("v1", 25)


def test_as_of_join(spark):
    """Against a plain search, with a hot key, equal instants, null keys and instants, at several cuts."""
    import random
    rnd = random.Random(7)
    keys = ["hot"] * 5 + ["a", "b", None]
    events = [(rnd.choice(keys), rnd.choice([None, *range(40)]), i, f"v{i}") for i in range(400)]
    probes = [(i, rnd.choice([*keys, "none"]), rnd.choice([None, *range(-2, 45)])) for i in range(400)]
    want = {}
    for n, k, t in probes:
        held = [e for e in events if k is not None and t is not None and e[0] == k and e[1] is not None and e[1] <= t]
        want[n] = max(held, key=lambda e: (e[1], e[2]))[3] if held else None
    left = spark.createDataFrame(probes, "n int, id string, at int")
    right = spark.createDataFrame(events, "id string, em int, seq int, para string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for cuts in ("1", "4", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", cuts)
            got = windows.as_of_join(left, right, "id", "at", "em", ["seq"], ["para"])
            assert got.columns == ["n", "id", "at", "vigente_para"]
            assert {r.n: r.vigente_para for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert windows.as_of_join(left, right.limit(0), "id", "at", "em", ["seq"], ["para"]).filter("vigente_para IS NOT NULL").count() == 0
    assert windows.as_of_join(left.limit(0), right, "id", "at", "em", ["seq"], ["para"]).count() == 0


def test_entities_by_day_equal_a_run_over_everything(spark, tmp_path):
    """Chains that grow at both ends, joins of old entities, repeated and lone postings, at several orders of arrival."""
    import random
    rnd = random.Random(9)
    rows = [(f"s{i}:{rnd.randrange(200)}", f"Senior Product Designer ({1000 + rnd.randrange(40)})", f"Co {rnd.randrange(6)}",
             f"https://x.example.com/jobs/{rnd.randrange(150)}", i) for i in range(160)] + [("lone:1", "x", "y", None, 900), (None, "x", "y", None, 901)]
    kind = "id_externo string, titulo string, empresa string, link string, seq int"
    everything = spark.createDataFrame(rows, kind)
    keyed = resolve.with_identity(everything.filter("id_externo IS NOT NULL"))
    labels = {r.node: r.label for r in resolve.component_labels(resolve.identity_edges(keyed)).collect()}
    want = {r[0]: labels.get(r[0], r[0]) for r in rows if r[0]}
    assert len(set(want.values())) < len(want) - 20
    for order, days in ((1, 4), (-1, 2)):
        index = entities.EntityIndex(spark, f"{tmp_path}/{days}", parts=4)
        for day in range(days):
            index.add(spark.createDataFrame(rows[::order][day * len(rows) // days: (day + 1) * len(rows) // days], kind))
        assert {r.id_externo: r.cluster for r in index.clusters().collect()} == want
    # The same postings again change nothing; one new posting reads and writes few parts.
    before = [t.manifest()["parts"] for t in (index.centers, index.labels, index.roots)]
    assert index.add(everything.limit(1)).count() == 0
    wide = entities.EntityIndex(spark, f"{tmp_path}/wide", parts=32)
    wide.add(everything)
    parts = wide.centers.manifest()["parts"]
    wide.add(spark.createDataFrame([("new:1", "Designer", "Z", "https://z.example.com/1", 1)], kind))
    assert sum(parts.get(p) != v for p, v in wide.centers.manifest()["parts"].items()) <= 2
    assert len(wide.labels.near(spark.createDataFrame([("new:1",)], "node string")).inputFiles()) == 1 and before
