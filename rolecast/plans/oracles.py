"""The same questions as plain SQL for a single-node engine, written independently.

Patterns avoid look-around, which the oracle's regular expressions do not have.
"""

from __future__ import annotations

import re

from rolecast.config import DEFAULT_KEYWORDS as KW
from rolecast.config import SOURCE_PRIORITY
from rolecast.functions.text import EN_WORDS, META_TEXT, PT_WORDS, fold
from rolecast.operators.filters import ACCEPTS_LATAM
from rolecast.plans.content_queries import LANGUAGE_GROUPS, STOP
from rolecast.plans.inputs import POSTINGS_SQL

NOW = "TIMESTAMP '2001-08-02 00:00:00'"
POSTINGS = "postings AS (" + POSTINGS_SQL.format(orders="orders", customer="customer", nation="nation") + ")"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def esc(s: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", s)


def nt(x: str) -> str:
    """Accents off, lower case, white space collapsed."""
    return f"trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '\\s+', ' ', 'g'))"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def term(x: str, t: str) -> str:
    t = fold(t)
    if " " in t:
        return f"contains({x}, {q(t)})"
    return rx(x, f"(^|[^a-z0-9]){esc(t)}(s|es|is)?([^a-z0-9]|$)")


def bounded(x: str, t: str) -> str:
    t = fold(t)
    plural = "s?" if len(t) > 3 and not t.endswith("s") else ""
    return rx(x, rf"(^|[^\p{{L}}\p{{N}}]){esc(t)}{plural}($|[^\p{{L}}\p{{N}}])")


def any_of(conds) -> str:
    return "(" + " OR ".join(conds) + ")"


def first_of(x: str, terms, test) -> str:
    return "CASE " + " ".join(f"WHEN {test(x, t)} THEN {q(t)}" for t in terms) + " END"


def has(x: str, t: str) -> str:
    return f"contains({x}, {q(fold(t))})"


def joined(parts) -> str:
    """Concatenation of what is not NULL."""
    return "concat_ws('|', " + ", ".join(parts) + ")"


def listed(x: str) -> str:
    """How many parts :func:`joined` put together."""
    return f"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, '|')) END)"


PRIORITY = "CASE fonte " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in SOURCE_PRIORITY.items()) + " ELSE 5 END"

NATION_PLACE = "CASE pais WHEN 'NATION_0' THEN 'Brazil' WHEN 'NATION_1' THEN 'Latin America' WHEN 'NATION_2' THEN 'Americas' ELSE pais END"

# Features of the derived postings. Their links carry only tracking parameters and p=1.
LINK = """concat(regexp_extract(link, 'https://www\\.([^/]+)', 1), regexp_extract(link, 'https://[^/]+(/jobs/\\d+)', 1),
  CASE WHEN contains(link, 'p=1') THEN '?p=1' ELSE '' END)"""
REQ = "nullif(regexp_extract(titulo, '\\((\\d{3,6})\\)', 1), '')"
COMPARABLE = (
    "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace("
    + nt("titulo") + r", '\([^)]*\)', ' ', 'g'), ' - remoto', ' '), 'designer de produto', 'product designer'),"
    r" 'ux/ui', 'uiux'), 'senior', 'sr'), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))")
KEYED = f"""{POSTINGS}, keyed AS (
  SELECT *, {LINK} AS chave_link, {REQ} AS requisicao,
    {nt('empresa')} || '##' || {REQ} AS chave_requisicao,
    {nt('empresa')} || '::' || nullif({COMPARABLE}, '') AS chave_anuncio
  FROM postings)"""

# Components: stars per key, then the smallest id reached along the edges.
CLUSTERS = f"""RECURSIVE {KEYED},
members AS (SELECT id_externo AS node, 'l:' || chave_link AS k FROM keyed
  UNION ALL SELECT id_externo, 'r:' || chave_requisicao FROM keyed WHERE chave_requisicao IS NOT NULL),
centers AS (SELECT k, min(node) AS c FROM members GROUP BY k),
edges AS (SELECT DISTINCT node AS a, c AS b FROM members JOIN centers USING (k) WHERE node <> c
  UNION SELECT DISTINCT c, node FROM members JOIN centers USING (k) WHERE node <> c),
reach(node, label) AS (SELECT id_externo, id_externo FROM keyed
  UNION SELECT e.b, r.label FROM reach r JOIN edges e ON r.node = e.a WHERE r.label < e.b),
clusters AS (SELECT node AS id_externo, min(label) AS cluster FROM reach GROUP BY node)"""
SURVIVORS = f"""{CLUSTERS},
labelled AS (SELECT k.*, c.cluster, row_number() OVER (PARTITION BY c.cluster ORDER BY {PRIORITY} DESC, k.seq) AS rn
  FROM keyed k JOIN clusters c USING (id_externo)),
survivors AS (SELECT * FROM labelled WHERE rn = 1)"""

SENIORITY = (
    "CASE WHEN " + rx("' ' || " + nt("titulo") + " || ' '",
                      " (" + "|".join(esc(fold(x)) for x in KW.junior_terms) + ")(s|es|is)?([^a-z0-9]|$)")
    + " THEN 'junior' WHEN " + rx("' ' || " + nt("titulo") + " || ' '",
                                  " (senior|sr|especialista|specialist|lead|staff|principal|iii)[ .]")
    + " THEN 'senior' WHEN " + rx("' ' || " + nt("titulo"), " (pleno|mid-level|mid level|intermediario|ii)")
    + " THEN 'pleno' ELSE 'sem_rotulo' END")
DE = "CAST(replace(regexp_extract(descricao, 'R\\$ ([0-9.]+)', 1), '.', '') AS DOUBLE)"
PERIOD = "regexp_extract(descricao, 'por (mes|ano|hora)', 1)"
MONTHLY = f"({DE} * CASE {PERIOD} WHEN 'mes' THEN 1.0 WHEN 'ano' THEN 1.0 / 12 ELSE 160.0 END)"
SALARY_TEXT = (
    f"('R$ ' || regexp_replace(CAST(CAST(floor({DE} / 100 + 0.5) / 10 AS DECIMAL(12, 1)) AS VARCHAR), '\\.0$', '')"
    f" || 'k' || CASE {PERIOD} WHEN 'hora' THEN '/hora' WHEN 'ano' THEN '/ano' ELSE '' END)")
AGE = f"CAST(floor((epoch_us({NOW}) - epoch_us(publicada_em)) / 86400000000.0) AS INTEGER)"


def window(new=7, recent=21, stalled=30):
    return (f"CASE WHEN {AGE} <= {new} THEN 'nova' WHEN {AGE} <= {recent} THEN 'recente' "
            f"WHEN {AGE} <= {stalled} THEN 'parada' ELSE 'zumbi' END")


TITLE_MODEL = ("CASE WHEN " + rx(nt("titulo"), "hibrid|hybrid") + " THEN 'hibrido' WHEN "
               + rx(nt("titulo"), "presencial|on.?site|no escritorio") + " THEN 'presencial' WHEN "
               + rx(nt("titulo"), "remot|home ?office|anywhere") + " THEN 'remoto' END")
# No body of these postings names a work model.
BLOCKED = f"CASE WHEN modelo IN ('hibrido', 'presencial') THEN modelo WHEN ({TITLE_MODEL}) IN ('hibrido', 'presencial') THEN ({TITLE_MODEL}) END"
REMOTE = f"(coalesce(modelo = 'remoto', false) OR coalesce(({TITLE_MODEL}) = 'remoto', false))"


def model_reason(hybrid=False, onsite=False):
    ok = [m for m, on in (("hibrido", hybrid), ("presencial", onsite)) if on]
    accepted = f"({BLOCKED}) IN ({', '.join(map(q, ok))})" if ok else "false"
    return (f"CASE WHEN ({BLOCKED}) IS NULL OR {accepted} THEN NULL ELSE CASE WHEN {REMOTE} THEN "
            f"'conflito de modalidade: ' ELSE '' END || ({BLOCKED}) || ': so remoto entra' END")


def reason(hybrid=False, onsite=False, floor=8000, new=7, recent=21, stalled=30, pool=400, marketing=600, deadline=None):
    t, framing = nt("titulo"), nt("titulo") + " || ' ' || " + nt(f"substr(descricao, 1, {pool})")
    ended = f"CASE WHEN {deadline} < {NOW} THEN 'prazo vencido' END," if deadline else ""
    area = any_of(has(t, k) for k in KW.title_weights)
    return f"""coalesce(
      CASE WHEN {t} = '' THEN 'sem titulo' END,
      'titulo excluido: ' || {first_of(t, KW.title_excluded, term)},
      'outra disciplina: ' || {first_of(t, KW.role_excluded, term)},
      CASE WHEN NOT {area} THEN 'titulo fora da area' END,
      'nao e vaga aberta: ' || {first_of(framing, KW.talent_pool, term)},
      'empregador de outra disciplina: ' || {first_of(nt('empresa'), KW.employer_excluded, has)},
      'vaga de marketing: ' || {first_of(nt(f'substr(descricao, 1, {marketing})'), KW.marketing_framing, has)},
      CASE WHEN ({SENIORITY}) = 'junior' THEN 'senioridade: junior' END,
      CASE WHEN {MONTHLY} < {floor} THEN 'salario abaixo do piso: ' || {SALARY_TEXT} || ' (~R$ ' || CAST(CAST(floor({MONTHLY} + 0.5) AS BIGINT) AS VARCHAR) || '/mes)' END,
      {model_reason(hybrid, onsite)},
      {ended}
      CASE WHEN ({window(new, recent, stalled)}) = 'zumbi' THEN 'zumbi: mais de {stalled} dias sem sinal de vida' END)"""


WIDE = dict(hybrid=True, onsite=True, floor=0, new=1000, recent=2000, stalled=100000)
JUDGED = f"{POSTINGS}, judged AS (SELECT *, {reason()} AS reason FROM postings)"
JUDGED_WIDE = f"judged AS (SELECT *, {reason(**WIDE)} AS reason FROM postings)"

BODY = nt("titulo || ' ' || empresa || ' ' || descricao")


def title_points(t):
    weights = sorted(set(KW.title_weights.values()), reverse=True)
    return "CASE " + " ".join(
        f"WHEN {any_of(bounded(t, k) for k, v in KW.title_weights.items() if v == w)} THEN {w}" for w in weights
    ) + " ELSE 0 END"


def domain(x):
    cleaned = x
    for phrase in KW.domain_neutral:
        cleaned = (rf"regexp_replace({cleaned}, '(^|[^\p{{L}}\p{{N}}]){esc(fold(phrase))}"
                   rf"{'' if phrase.endswith('s') else 's?'}($|[^\p{{L}}\p{{N}}])', '\1 \2', 'g')")
    high = any_of(bounded("c", t) for t in KW.domain_high)
    medium = any_of(bounded("c", t) for t in KW.domain_medium)
    return f"(SELECT CASE WHEN {high} THEN 10 WHEN {medium} THEN 7 ELSE 3 END FROM (SELECT {cleaned} AS c))"


def signals(x):
    """The first present term of each group, in list order, joined by '|'."""
    ordered = list(dict.fromkeys(fold(s) for s in KW.signals))
    group = {fold(t): i for i, g in enumerate(KW.signal_groups) for t in g}
    out = []
    for i, t in enumerate(ordered):
        earlier = [o for o in ordered[:i] if t in group and group.get(o) == group[t]]
        cond = bounded(x, t) + "".join(f" AND NOT {bounded(x, e)}" for e in earlier)
        out.append(f"CASE WHEN {cond} THEN {q(t)} END")
    return joined(out)


ENGLISH = lambda x: (
    f"CASE WHEN {any_of(bounded(x, t) for t in KW.english_strong)} THEN 'forte' "
    f"WHEN {any_of(bounded(x, t) for t in KW.english_desirable)} THEN 'desejavel' ELSE 'nenhuma' END")

SCORED = f"""{POSTINGS}, {JUDGED_WIDE},
feat AS (SELECT *, {BODY} AS corpo, ({SENIORITY}) AS nivel, {MONTHLY} AS mensal FROM judged WHERE reason IS NULL),
parts AS (SELECT *, {title_points(nt('titulo'))} AS p_titulo,
  CASE nivel WHEN 'senior' THEN 10 WHEN 'pleno' THEN CASE WHEN mensal > 10000 THEN 10 ELSE 4 END WHEN 'junior' THEN 0 ELSE 6 END AS p_senioridade,
  {domain('corpo')} AS p_dominio, {signals('corpo')} AS achados, 0 AS p_frescor_base, {ENGLISH('corpo')} AS ingles,
  CASE WHEN {AGE} <= 3 THEN 5 WHEN {AGE} <= 7 THEN 4 WHEN {AGE} <= 14 THEN 2 WHEN {AGE} <= 30 THEN 1 ELSE 0 END AS p_frescor
  FROM feat),
scored AS (SELECT *, least({listed('achados')} * 1.5, 15.0) AS p_sinais,
  greatest(0, floor((p_titulo + p_senioridade + p_dominio + least({listed('achados')} * 1.5, 15.0) + p_frescor
    - CASE ingles WHEN 'forte' THEN 4 ELSE 0 END) * 10 + 0.5) / 10) AS determinado FROM parts)"""

JUDGEMENTS = """judgements AS (
  SELECT p.id_externo AS id, CAST(quality * 30 + toxic * 25 AS DOUBLE) AS nota,
    CASE WHEN quality = 1 THEN 'boa' END AS resumo, CASE WHEN toxic = 1 THEN 'revisar' END AS gaps, toxic, seq AS jseq
  FROM labels JOIN postings p ON p.seq = doc_id)"""
EVENTS = """board_events AS (
  SELECT CAST(user_id AS VARCHAR) AS id, ts AS em, event_id AS seq, CASE event_type WHEN 'signup' THEN 'Avaliar'
    WHEN 'view' THEN 'Avaliar' WHEN 'click' THEN 'Aplicar' WHEN 'purchase' THEN 'Já apliquei' ELSE 'Cancelada' END AS para
  FROM events)"""
CURRENT = f"""{EVENTS}, current_status AS (
  SELECT id, para AS status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY em DESC, seq DESC) AS rn
    FROM board_events) WHERE rn = 1)"""
BOARD = f"""{CURRENT}, board AS (
  SELECT CASE WHEN k.seq % 3 = 0 THEN k.id_externo ELSE 'manual:' || CAST(k.seq AS VARCHAR) END AS id, status,
    CASE WHEN k.seq % 3 <> 1 THEN titulo END AS titulo, CASE WHEN k.seq % 3 <> 1 THEN empresa END AS empresa,
    CASE WHEN k.seq % 3 = 1 THEN link END AS url, k.seq AS ord,
    CASE WHEN k.seq % 3 = 1 THEN chave_link END AS b_link, CASE WHEN k.seq % 3 <> 1 THEN chave_requisicao END AS b_req,
    CASE WHEN k.seq % 3 <> 1 THEN chave_anuncio END AS b_ann, CASE WHEN k.seq % 3 <> 1 THEN requisicao END AS b_requisicao
  FROM current_status c JOIN keyed k ON c.id = CAST(k.seq AS VARCHAR))"""


def index(kind, column):
    return (f"ix_{kind} AS (SELECT * FROM (SELECT {column} AS chave, id, status, b_requisicao, row_number() OVER "
            f"(PARTITION BY {column} ORDER BY ord DESC) AS rn FROM board WHERE {column} IS NOT NULL) WHERE rn = 1)")


# Links and canonical ids: these hosts have no id in the link, so the canonical id is the own one.
LOOKUP = f"""{BOARD}, {index('id', 'id')}, {index('link', 'b_link')}, {index('req', 'b_req')}, {index('ann', 'b_ann')},
seen AS (SELECT k.*, coalesce(i.status, l.status, r.status) AS status_sure,
    CASE WHEN a.status IS NOT NULL AND NOT coalesce(k.requisicao <> a.b_requisicao, false) THEN a.status END AS status_weak
  FROM keyed k LEFT JOIN ix_id i ON i.chave = k.id_externo LEFT JOIN ix_link l ON l.chave = k.chave_link
    LEFT JOIN ix_req r ON r.chave = k.chave_requisicao LEFT JOIN ix_ann a ON a.chave = k.chave_anuncio)"""
CONCLUDED = "('Já apliquei', 'Entrevista', 'Cancelada', 'Aplicado por IA')"
SEEN = f"""id_externo, status_sure IS NOT NULL AS no_notion, status_sure AS status_notion,
  coalesce(status_sure IN {CONCLUDED}, false) AS concluida, status_sure IS NULL AND status_weak IS NOT NULL AS conflito_identidade,
  CASE WHEN status_sure IS NULL THEN status_weak END AS possivel_duplicata_quadro"""
HYDRATED = f"""{KEYED}, {JUDGED_WIDE}, {SCORED.split(JUDGED_WIDE + ',')[1]}, {JUDGEMENTS}, {LOOKUP},
hydrated AS (SELECT s.id_externo, s.titulo, s.empresa, s.descricao, j.id IS NOT NULL AS lida, j.nota AS semantico, {SEEN.replace('id_externo, ', '', 1).strip()},
    s.determinado, CASE WHEN j.id IS NOT NULL THEN j.toxic = 1 END AS julgamento_desatualizado,
    CAST(greatest(0, least(100, floor(s.determinado + CASE WHEN j.nota IS NULL THEN 0 WHEN j.nota > 40 THEN 40 ELSE j.nota END + 0.5))) AS INTEGER) AS compatibilidade
  FROM scored s JOIN seen b USING (id_externo) LEFT JOIN judgements j ON j.id = s.id_externo)"""
BAND = ("CASE WHEN compatibilidade >= 75 THEN 'Aplicar ja' WHEN compatibilidade >= 55 THEN 'Vale olhar' "
        "WHEN compatibilidade >= 40 THEN 'Radar' ELSE 'Fora' END")
QUEUE = f"""{HYDRATED}, queue AS (SELECT *, CAST(least(100, floor(determinado + 40 + 0.5)) AS INTEGER) AS teto
  FROM hydrated WHERE NOT concluida AND (NOT lida OR coalesce(julgamento_desatualizado, false)))"""

# A third of the ids are looked up under the id of an earlier posting.
ALT = f"""{POSTINGS}, {JUDGEMENTS}, alt AS (SELECT *, 'gupy:' || CAST(seq - seq % 5 AS VARCHAR) AS id_canonico FROM postings),
hit AS (SELECT a.*, coalesce(j1.id, j2.id) AS chave, coalesce(j1.nota, j2.nota) AS nota,
    CASE WHEN j1.id IS NOT NULL THEN j1.resumo ELSE j2.resumo END AS resumo,
    CASE WHEN j1.id IS NOT NULL THEN j1.gaps ELSE j2.gaps END AS gaps,
    CASE WHEN j1.id IS NOT NULL THEN j1.toxic = 1 WHEN j2.id IS NOT NULL THEN j2.toxic = 1 OR d.descricao <> a.descricao END AS velho
  FROM alt a LEFT JOIN judgements j1 ON j1.id = a.id_externo LEFT JOIN judgements j2 ON j2.id = a.id_canonico
    LEFT JOIN postings d ON d.id_externo = j2.id)"""

HALVES = f"""{POSTINGS}, old AS (SELECT * FROM postings WHERE publicada_em < TIMESTAMP '1998-01-01'),
fresh AS (SELECT * REPLACE (titulo || ' II' AS titulo) FROM postings WHERE publicada_em >= TIMESTAMP '1997-01-01'),
merged AS (SELECT coalesce(n.id_externo, o.id_externo) AS id_externo, coalesce(n.titulo, o.titulo) AS titulo,
    CASE WHEN o.id_externo IS NOT NULL THEN '1998-01-01' ELSE '2001-08-02' END AS encontrada_em,
    coalesce(n.fonte, o.fonte) AS fonte, coalesce(n.empresa, o.empresa) AS empresa, coalesce(n.modelo, o.modelo) AS modelo,
    coalesce(n.descricao, o.descricao) AS descricao, coalesce(n.publicada_em, o.publicada_em) AS publicada_em
  FROM old o FULL JOIN fresh n ON o.id_externo = n.id_externo)"""

EMPHASIS = ", ".join(
    "{'balde': " + q(name) + ", 'acertos': "
    + joined(f"CASE WHEN {term('t', x)} THEN {q(fold(x))} END" for x in terms) + "}"
    for name, terms in KW.emphasis_buckets.items())

POSTING_ORACLES = {
    "normalize_links": f"WITH {KEYED} SELECT id_externo, chave_link FROM keyed",
    "link_dedupe_survivor": f"""WITH {KEYED} SELECT chave_link, id_externo, fonte FROM (
        SELECT *, row_number() OVER (PARTITION BY chave_link ORDER BY {PRIORITY} DESC, seq) AS rn FROM keyed) WHERE rn = 1""",
    "comparable_titles": f"WITH {POSTINGS} SELECT id_externo, {COMPARABLE} AS titulo_comparavel FROM postings",
    "requisition_keys": f"WITH {KEYED} SELECT id_externo, chave_requisicao, chave_anuncio, requisicao FROM keyed",
    "entity_clusters": f"WITH {CLUSTERS} SELECT id_externo, cluster FROM clusters",
    "entity_clusters_by_day": f"WITH {CLUSTERS} SELECT id_externo, cluster FROM clusters",
    "entity_survivors": f"""WITH {SURVIVORS} SELECT s.cluster, s.id_externo, s.fonte,
        coalesce(s.modelo, (SELECT arg_min(l.modelo, l.rn) FROM labelled l WHERE l.cluster = s.cluster AND l.modelo IS NOT NULL)) AS modelo,
        (SELECT count(*) - 1 FROM labelled l WHERE l.cluster = s.cluster) AS n_fundidas,
        coalesce((SELECT string_agg(DISTINCT l.fonte, '|' ORDER BY l.fonte) FROM labelled l WHERE l.cluster = s.cluster AND l.fonte <> s.fonte), '') AS tambem_visto_em
        FROM survivors s""",
    "entity_aliases": f"""WITH {SURVIVORS} SELECT s.id_externo, l.id_externo AS alias FROM labelled l JOIN survivors s USING (cluster)
        WHERE l.id_externo <> s.id_externo""",
    "weak_duplicates": f"""WITH {SURVIVORS}, centers2 AS (SELECT chave_anuncio, min(id_externo) AS c FROM survivors
          WHERE requisicao IS NULL AND chave_anuncio IS NOT NULL GROUP BY 1),
        pairs AS (SELECT s.id_externo AS a, c FROM survivors s JOIN centers2 USING (chave_anuncio) WHERE s.id_externo <> c)
        SELECT a AS id_externo, c AS possivel_duplicata FROM pairs UNION ALL SELECT c, a FROM pairs""",
    "collision_count": f"WITH {CLUSTERS} SELECT count(*) - count(DISTINCT cluster) AS colisoes FROM clusters",
    "classify_seniority": f"WITH {POSTINGS} SELECT id_externo, {SENIORITY} AS nivel FROM postings",
    "work_model": f"""WITH {POSTINGS} SELECT id_externo, {model_reason()} AS motivo,
        coalesce({BLOCKED}, CASE WHEN {REMOTE} THEN 'remoto' END) AS modelo_final,
        ({BLOCKED}) IS NULL AND NOT {REMOTE} AS modelo_desconhecido FROM postings""",
    "salary_monthly": f"""WITH {POSTINGS} SELECT id_externo, {DE} AS de, 'BRL' AS moeda, {PERIOD} AS periodo,
        round({MONTHLY}, 2) AS mensal_brl, {SALARY_TEXT} AS salario_texto FROM postings""",
    "freshness_windows": f"WITH {POSTINGS} SELECT id_externo, {AGE} AS idade_dias, {window()} AS janela FROM postings",
    "functions_in_sql": f"""WITH {POSTINGS}, y AS (SELECT *, CASE seq % 4 WHEN 0 THEN 2080 WHEN 1 THEN 26 WHEN 3 THEN 1 END AS vezes FROM postings)
        SELECT id_externo, regexp_replace({nt('empresa')}, '[^a-z0-9]+', '-', 'g') AS slug,
          regexp_replace(regexp_replace({nt('titulo')}, '[^a-z0-9 -]+', '', 'g'), '[ -]+', '-', 'g') AS slug_vaga, pais || ', Remote' AS local,
          'workday:acme.wd1.myworkdayjobs.com:r000' || CAST(seq AS VARCHAR) AS requisicao, 'Acme Nation ' || split_part(pais, '_', 2) AS empresa_do_slug,
          CASE WHEN seq % 4 <> 3 AND seq % 3 > 0 THEN CAST(seq % 3 * 1000 AS DOUBLE) END AS de,
          CASE WHEN seq % 3 > 0 THEN CASE seq % 4 WHEN 0 THEN 'hora' WHEN 1 THEN 'mes' WHEN 2 THEN 'ano' END END AS periodo,
          nullif(CAST(seq AS DOUBLE), 0) AS bruto_de, CASE WHEN seq > 0 THEN 'USD' END AS bruto_moeda, CASE WHEN seq > 0 THEN 'mes' END AS bruto_periodo, CAST(vezes * least(seq % 100, seq % 7) AS DOUBLE) AS anual_min,
          CAST(vezes * greatest(seq % 100, seq % 7) AS DOUBLE) AS anual_max, CASE WHEN vezes > 0 THEN 'USD' END AS anual_moeda,
          CAST(CASE WHEN seq % 300 = 0 THEN 10 ELSE seq % 300 END * 1000 AS DOUBLE) AS faixa_min, CAST((seq % 300 + 10) * 1000 AS DOUBLE) AS faixa_max,
          strftime({NOW} - to_days(CAST(seq % 60 + 2 AS INTEGER)), '%Y-%m-%d') AS no_quadro,
          CASE WHEN seq % 5 > 0 THEN strftime({NOW} - to_days(CAST(seq % 30 + 2 AS INTEGER)), '%Y-%m-%d') END AS no_workday,
          greatest(1, date_diff('day', CAST(publicada_em AS DATE), CAST({NOW} AS DATE))) AS dias FROM y""",
    "postings_in_sql": f"""WITH {KEYED} SELECT id_externo, chave_link, chave_requisicao, chave_anuncio, requisicao, {COMPARABLE} AS titulo_comparavel,
        {SENIORITY} AS nivel, {DE} AS de, {PERIOD} AS periodo, round({MONTHLY}, 2) AS mensal_brl, {SALARY_TEXT} AS salario_texto, {AGE} AS idade_dias,
        {window()} AS janela FROM keyed""",
    "freshness_points": f"""WITH {POSTINGS} SELECT CASE WHEN {AGE} <= 3 THEN 5 WHEN {AGE} <= 7 THEN 4 WHEN {AGE} <= 14 THEN 2
        WHEN {AGE} <= 30 THEN 1 ELSE 0 END AS pontos, count(*) AS n FROM postings GROUP BY 1""",
    "eligibility": f"""WITH {POSTINGS}, places AS (SELECT id_externo, concat_ws(' | ', modelo, CASE WHEN modelo = 'remoto' THEN NULL ELSE {NATION_PLACE} END) AS j FROM postings),
        hits AS (SELECT *, {first_of(nt('j'), ACCEPTS_LATAM, term)} AS hit, j = 'remoto' AS vago FROM places)
        SELECT id_externo, hit IS NOT NULL OR vago AS entra, CASE WHEN hit IS NOT NULL THEN true WHEN NOT vago THEN false END AS latam,
          CASE WHEN hit IS NOT NULL THEN 'aceita ' || hit WHEN vago THEN 'elegibilidade nao declarada'
            ELSE 'local especifico, sem mencao a LATAM: ' || substr(j, 1, 48) END AS motivo FROM hits""",
    "filter_reasons": f"WITH {JUDGED} SELECT id_externo, reason FROM judged",
    "filter_reasons_hybrid_profile": f"WITH {POSTINGS} SELECT id_externo, {reason(hybrid=True, floor=0)} AS reason FROM postings",
    "filter_reasons_by_reach": f"""WITH {POSTINGS}, p AS (SELECT * REPLACE (repeat('Sobre a vaga. ', 60) || CASE seq % 5 WHEN 0 THEN {q(KW.talent_pool[0])} WHEN 1 THEN {q(KW.marketing_framing[0])} ELSE '' END || '. ' || descricao AS descricao,
            CASE WHEN seq % 13 = 0 THEN {q('Grupo ' + KW.employer_excluded[0])} ELSE empresa END AS empresa), CASE WHEN seq % 6 = 0 THEN TIMESTAMP '2001-07-01 00:00:00' END AS prazo FROM postings),
          j AS (SELECT id_externo, 'publicado' AS alcance, {reason(hybrid=True, floor=0, deadline='prazo')} AS reason FROM p
            UNION ALL SELECT id_externo, 'inteiro', {reason(hybrid=True, floor=0, pool=100000, marketing=100000, deadline='prazo')} FROM p)
        SELECT *, string_split(reason, ':')[1] AS codigo FROM j""",
    "reason_histogram": f"WITH {JUDGED} SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1",
    "source_counts": f"WITH {JUDGED} SELECT fonte, count(*) AS n FROM judged WHERE reason IS NULL GROUP BY 1",
    "score_postings": f"""WITH {SCORED} SELECT id_externo, p_titulo, p_senioridade, p_dominio, p_sinais, p_frescor,
        achados AS sinais, nivel, determinado FROM scored""",
    "document_scores": f"""WITH d AS (SELECT doc_id, {nt('text')} AS t FROM documents), s AS (SELECT *, {signals('t')} AS a FROM d)
        SELECT doc_id, {domain('t')} AS dominio, a AS sinais, least({listed('a')} * 1.5, 15.0) AS pontos_sinais,
          {ENGLISH('t')} AS ingles FROM s""",
    "hydrated_view": f"""WITH {HYDRATED} SELECT id_externo, lida, semantico, no_notion, status_notion, concluida, conflito_identidade,
        compatibilidade, {BAND} AS faixa FROM hydrated""",
    "rank_top_k": f"""WITH {HYDRATED} SELECT id_externo, titulo, empresa, compatibilidade FROM hydrated WHERE NOT concluida
        ORDER BY compatibilidade DESC, id_externo LIMIT 10""",
    "reading_queue": f"WITH {QUEUE} SELECT id_externo, teto, julgamento_desatualizado FROM queue",
    "queue_histogram": f"""WITH {QUEUE} SELECT CASE WHEN teto >= 85 THEN '>= 85' WHEN teto >= 75 THEN '75-84' WHEN teto >= 65 THEN '65-74'
        ELSE '< 65' END AS faixa, count(*) AS n FROM queue GROUP BY 1""",
    "queue_gaps": f"""WITH {QUEUE} SELECT count(*) AS fila, count(*) FILTER (WHERE length(descricao) < 200) AS sem_descricao,
        count(*) FILTER (WHERE coalesce(julgamento_desatualizado, false)) AS reeditadas FROM queue""",
    "brief_candidates": f"WITH {HYDRATED} SELECT id_externo, compatibilidade FROM hydrated WHERE compatibilidade >= 65",
    "run_totals": f"""WITH {KEYED}, {JUDGED_WIDE}, {JUDGEMENTS}, {LOOKUP},
        r AS (SELECT g.*, j.id IS NOT NULL AS lida, b.status_sure IS NOT NULL AS no_notion, coalesce(b.status_sure IN {CONCLUDED}, false) AS concluida,
            g.publicada_em >= TIMESTAMP '2001-01-01' AS nova
          FROM judged g JOIN seen b USING (id_externo) LEFT JOIN judgements j ON j.id = g.id_externo)
        SELECT count(*) AS unicas, count(*) FILTER (WHERE reason IS NULL) AS aprovadas, count(*) FILTER (WHERE reason IS NOT NULL) AS descartadas,
          count(*) FILTER (WHERE reason IS NULL AND nova) AS novas_no_cache,
          count(*) FILTER (WHERE reason IS NULL AND NOT concluida AND lida) AS lidas,
          count(*) FILTER (WHERE reason IS NULL AND NOT concluida AND NOT lida) AS aguardando_leitura,
          count(*) FILTER (WHERE reason IS NULL AND concluida) AS concluidas,
          count(*) FILTER (WHERE reason IS NULL AND NOT concluida AND no_notion) AS ja_no_quadro,
          count(*) FILTER (WHERE reason = 'inscricoes encerradas') AS encerradas, count(*) FILTER (WHERE starts_with(reason, 'zumbi')) AS zumbis,
          count(*) FILTER (WHERE publicada_em IS NULL) AS sem_data, count(*) FILTER (WHERE link IS NULL) AS sem_link,
          count(*) FILTER (WHERE coalesce(descricao, '') = '') AS sem_descricao FROM r""",
    "judgement_join": f"""WITH {ALT} SELECT id_externo, nota AS semantico, chave IS NOT NULL AS lida,
        CASE WHEN chave <> id_externo THEN chave END AS julgamento_veio_de, velho AS julgamento_desatualizado, resumo, gaps FROM hit""",
    "judgement_migration": f"""WITH {ALT}, moves AS (SELECT chave, min(id_externo) AS novo FROM hit WHERE chave <> id_externo GROUP BY 1)
        SELECT coalesce(m.novo, j.id) AS id, j.nota FROM judgements j LEFT JOIN moves m ON m.chave = j.id""",
    "board_join_priority": f"WITH {KEYED}, {LOOKUP} SELECT {SEEN} FROM seen",
    "board_index": f"""WITH {KEYED}, {LOOKUP} SELECT 'id' AS tipo, chave, id, status FROM ix_id UNION ALL SELECT 'link', chave, id, status FROM ix_link
        UNION ALL SELECT 'req', chave, id, status FROM ix_req UNION ALL SELECT 'ann', chave, id, status FROM ix_ann""",
    "board_listing": f"""WITH {HYDRATED} SELECT b.id, b.status, coalesce(h.titulo, b.titulo) AS titulo, h.compatibilidade, h.id_externo IS NOT NULL AS no_cache
        FROM board b LEFT JOIN hydrated h ON h.id_externo = b.id""",
    "cache_upsert": f"WITH {HALVES} SELECT id_externo, titulo, encontrada_em FROM merged",
    "cache_expunge": f"""WITH {HALVES}, j AS (SELECT id_externo, {reason(**WIDE)} AS reason FROM merged)
        SELECT id_externo, reason FROM j WHERE reason IS NOT NULL""",
    "cache_removed_ids": f"WITH {SURVIVORS} SELECT id_externo FROM labelled WHERE rn > 1",
    "new_ids": f"WITH {HALVES} SELECT id_externo FROM fresh EXCEPT SELECT id_externo FROM old",
    "board_register": f"""WITH {KEYED}, {JUDGED_WIDE}, {BOARD}, ok AS (SELECT * FROM judged WHERE reason IS NULL)
        SELECT coalesce(b.id, o.id_externo) AS id, coalesce(b.status, 'Avaliar') AS status, coalesce(o.titulo, b.titulo) AS titulo,
          coalesce(o.empresa, b.empresa) AS empresa, o.fonte, CASE WHEN b.id IS NULL THEN '2001-08-02' ELSE '2001-01-01' END AS registrada_em
        FROM board b FULL JOIN ok o ON o.id_externo = b.id""",
    "board_moves": f"""WITH {KEYED}, {BOARD}, m AS (SELECT 'manual:' || e.id AS id, em, seq, para, b.status AS atual
          FROM board_events e JOIN board b ON b.id = 'manual:' || e.id),
        c AS (SELECT id, para, coalesce(lag(para) OVER (PARTITION BY id ORDER BY em, seq), atual) AS de FROM m)
        SELECT id, de, para, count(*) AS n FROM c WHERE de <> para GROUP BY ALL""",
    "board_moves_rejected": f"""WITH {KEYED}, {BOARD} SELECT 'vaga nao esta no quadro: manual:' || e.id AS motivo, count(*) AS n
        FROM board_events e LEFT JOIN board b ON b.id = 'manual:' || e.id WHERE b.id IS NULL GROUP BY 1""",
    "judgement_upsert": f"""WITH {POSTINGS}, {JUDGEMENTS}, n AS (SELECT p.id_externo AS id, least(40, greatest(0, arg_max(value, event_id) * 2)) AS nota,
          CASE WHEN arg_max(event_type, event_id) = 'view' THEN 'nova leitura' END AS resumo FROM events JOIN postings p ON p.seq = user_id GROUP BY 1)
        SELECT coalesce(n.id, j.id) AS id, round(coalesce(n.nota, j.nota), 2) AS nota, coalesce(n.resumo, j.resumo) AS resumo,
          CASE WHEN n.id IS NOT NULL THEN '2001-08-02' ELSE '2001-07-01' END AS lido_em FROM n FULL JOIN judgements j ON j.id = n.id""",
    "source_yield_rollup": """WITH per AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS fonte, count(DISTINCT l_orderkey) AS consultadas, count(*) AS brutas,
          count(*) FILTER (WHERE l_returnflag = 'R') AS falhas, count(*) FILTER (WHERE l_linestatus = 'O') AS importadas,
          count(*) FILTER (WHERE l_returnflag = 'A') AS invalidas, count(*) FILTER (WHERE l_discount = 0) AS duplicadas,
          bool_or(l_tax > 0.07) AS truncada, bool_and(l_quantity < 40) AS completa FROM lineitem GROUP BY 1),
        r AS (SELECT coalesce(fonte, 'TOTAL') AS fonte, sum(consultadas) AS consultadas, sum(brutas) AS brutas, sum(falhas) AS falhas,
          sum(importadas) AS importadas, sum(invalidas) AS invalidas, sum(duplicadas) AS duplicadas, bool_or(truncada) AS truncada,
          bool_and(completa) AS completa FROM per GROUP BY ROLLUP (fonte))
        SELECT *, CASE WHEN completa AND brutas > 0 THEN 'ok' WHEN completa THEN 'vazia' WHEN importadas > 0 THEN 'parcial' ELSE 'erro' END AS status FROM r""",
    "source_yield": f"""WITH {POSTINGS}, {JUDGED_WIDE} SELECT fonte, count(*) AS brutas,
        count(DISTINCT id_externo) FILTER (WHERE reason IS NULL) AS aproveitadas,
        count(*) - count(DISTINCT id_externo) FILTER (WHERE reason IS NULL) AS perdidas FROM judged GROUP BY 1""",
    "source_activation": f"""WITH {POSTINGS} SELECT fonte, count(*) AS n FROM postings WHERE fonte IN ('Gupy', 'Remotar', 'LinkedIn (Apify)') GROUP BY 1""",
    "emphasis_buckets": f"""WITH {POSTINGS}, b AS (SELECT id_externo, {nt("titulo || ' ' || descricao")} AS t FROM postings),
        e AS (SELECT id_externo, unnest([{EMPHASIS}]) AS x FROM b)
        SELECT id_externo, x.balde AS balde, x.acertos AS acertos, {listed('x.acertos')} AS n FROM e WHERE x.acertos <> ''""",
}

# ------------------------------------------------------------------ pages, documents, events

ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")]
PAGE_HOST = "regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '')"
PAGE_PATH = "regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')"
# The only parameters of these pages are utm_source, ref (tracking) and page.
PAGE_KEY = (f"lower({PAGE_HOST} || {PAGE_PATH} || CASE WHEN contains(url, 'page=') THEN '?page=' || regexp_extract(url, 'page=(\\d+)', 1) ELSE '' END)")


def decoded(x):
    for name, ch in ENTITIES:
        x = f"replace({x}, {q(name)}, {q(ch)})"
    return x


def collapsed(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


NO_SCRIPT = "regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g')"
CLEAN = collapsed(decoded(f"regexp_replace({decoded(NO_SCRIPT)}, '<[^>]*>', ' ', 'g')"))
TAG = """'<([^>"'']|"[^"]*"|''[^'']*'')+>'"""
STRIPPED = f"regexp_replace({NO_SCRIPT}, {TAG}, ' ', 'g')"
COPY, MARK = "'&copy;'", "chr(1)"


def kept_copyright(x):
    """The table of the provider feeds does not know &copy;."""
    return f"replace({decoded(f'replace({x}, {COPY}, {MARK})')}, {MARK}, {COPY})"


TO_TEXT = STRIPPED
for _ in range(2):
    TO_TEXT = f"regexp_replace({kept_copyright(TO_TEXT)}, {TAG}, ' ', 'g')"
TO_TEXT = collapsed(TO_TEXT)
NEW_BOARD = (f"'https://boards.greenhouse.io/' || split_part({PAGE_HOST}, '.', 1) || '/jobs/'")
PLAIN = lambda x: f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"
STOPS = ", ".join(q(w) for w in STOP)
PAIRS = f"""words AS (SELECT doc_id, unnest(string_split({PLAIN('text')}, ' ')) AS w, generate_subscripts(string_split({PLAIN('text')}, ' '), 1) AS i FROM documents),
pairs AS (SELECT a.doc_id, a.w || ' ' || b.w AS term FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.i = a.i + 1
  WHERE length(a.w) >= 3 AND length(b.w) >= 3 AND a.w NOT IN ({STOPS}) AND b.w NOT IN ({STOPS})),
counted AS (SELECT doc_id, term, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 2)"""
SENSITIVE = {
    "api_token": r"\b(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16})\b",
    "bearer": r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]{16,}", "cpf": r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", "digits11": r"\b\d{11}\b",
    "phone_br": r"\+55\s*\(?\d{2}\)?\s*9?\s*\d{4}-?\d{4}", "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
TAGS = joined(f"CASE WHEN {rx('text', p)} THEN {q(t)} END" for t, p in SENSITIVE.items())


def count_words(words):
    return f"len(regexp_extract_all(lower(text), {q(chr(92) + 'b(?:' + '|'.join(words) + ')' + chr(92) + 'b')}))"


def language_group_sql():
    """Per document and group: the first member used, and the members of the group."""
    return " UNION ALL ".join(
        f"SELECT doc_id, {first_of('t', g, lambda x, w: rx(x, f'(^| ){w}( |$)'))} AS termo, "
        f"[{', '.join(map(q, g))}] AS grupo FROM d" for g in LANGUAGE_GROUPS)


CONTENT_ORACLES = {
    "page_links": f"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*href\\s*=\\s*"[^"]+"[^>]*>.*?</a>') AS l FROM pages),
        u AS (SELECT page_id, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS pos FROM a)
        SELECT page_id, pos, replace(regexp_extract(b, 'href="([^"]+)"', 1), '&amp;', '&') AS href,
          {collapsed(decoded("regexp_replace(" + decoded("regexp_extract(b, '(?s)^<a[^>]*>(.*)</a>$', 1)") + ", '<[^>]*>', ' ', 'g')"))} AS texto FROM u""",
    "page_title": f"""SELECT page_id, nullif({collapsed(decoded("regexp_replace(" + decoded("regexp_extract(html, '(?is)<title[^>]*>(.{0,200}?)</title>', 1)") + ", '<[^>]*>', ' ', 'g')"))}, '') AS titulo FROM pages""",
    "page_text": f"WITH t AS (SELECT page_id, {TO_TEXT} AS t FROM pages) SELECT page_id, length(t) AS n, sha1(t) AS sha1 FROM t",
    "page_clean_html": f"WITH t AS (SELECT page_id, {CLEAN} AS t FROM pages) SELECT page_id, length(t) AS n, sha1(t) AS sha1 FROM t",
    "page_status": r"""SELECT page_id, nullif(lower(regexp_extract(html, '(?i)"status"\s*:\s*"([a-z_]+)"', 1)), '') AS status,
        CASE WHEN nullif(regexp_extract(html, '(?i)"status"\s*:\s*"([a-z_]+)"', 1), '') IS NOT NULL
          THEN regexp_matches(regexp_extract(html, '(?i)"status"\s*:\s*"([a-z_]+)"', 1), '(?i)^(published|open|active|live|publicada|aberta)$') END AS viva,
        nullif(regexp_extract(html, '(\d{4}-\d{2}-\d{2})T\d{2}:\d{2}', 1), '') AS data,
        CASE WHEN regexp_matches(html, 'uddg=|result__a') THEN 'ok' WHEN regexp_matches(html, '(?i)anomaly|blocked|captcha|unusual traffic') OR length(html) < 20000
          THEN 'blocked' ELSE 'empty' END AS situacao FROM pages""",
    "public_urls": f"""SELECT page_id, regexp_replace(url, '#.*$', '') AS url_publica, {PAGE_KEY} AS chave, substr(sha256({PAGE_KEY}), 1, 32) AS id_link FROM pages""",
    "page_duplicates": f"SELECT {PAGE_KEY} AS chave, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1",
    "known_url_classes": f"""WITH l AS (SELECT *, regexp_extract(split_part({PAGE_PATH}, '/', -1), '(\\d+)', 1) AS num FROM pages),
        b AS (SELECT *, {NEW_BOARD} || num AS board FROM l),
        landed AS (SELECT DISTINCT board FROM b WHERE NOT starts_with(url, 'https://m.'))
        SELECT CASE WHEN num = '' THEN 'sem_id' WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey % 5 = 0 AND CAST(o.o_orderkey AS VARCHAR) = num) THEN 'ja_no_cache'
          WHEN board NOT IN (SELECT board FROM landed) THEN 'nao_verificada' ELSE 'reprovada' END AS classe, count(*) AS n FROM b GROUP BY 1""",
    "unseen_companies": f"""WITH b AS (SELECT lower(split_part({PAGE_HOST}, '.', 1)) AS org, {NEW_BOARD} || CAST(page_id AS VARCHAR) AS url FROM pages),
        known AS (SELECT DISTINCT lower(CASE WHEN s_suppkey < 50 THEN 'blog' ELSE s_name END) AS org FROM supplier)
        SELECT 'greenhouse' AS provedor, org, min(url) AS exemplo FROM b WHERE org NOT IN (SELECT org FROM known) GROUP BY org""",
    "discovered_boards": f"""WITH {POSTINGS}, j AS (SELECT lower(empresa) AS org, count(*) AS total, count(*) FILTER (WHERE regexp_matches(titulo, '(?i)design')) AS design FROM postings GROUP BY 1)
        SELECT lower(c_name) AS org, coalesce(total, 0) AS total, coalesce(design, 0) AS design, coalesce(total, 0) > 0 AS aprovada FROM customer LEFT JOIN j ON j.org = lower(c_name)""",
    "doc_normalized": f"WITH t AS (SELECT doc_id, {nt('text')} AS t FROM documents) SELECT doc_id, length(t) AS n, sha1(t) AS sha1 FROM t",
    "doc_fingerprint_duplicates": f"""WITH f AS (SELECT doc_id, nullif({collapsed('text')}, '') AS t FROM documents)
        SELECT substr(sha1(t), 1, 12) AS impressao, min(doc_id) AS doc_id, count(*) AS n FROM f GROUP BY 1 HAVING count(*) > 1""",
    "doc_language_guess": f"""SELECT doc_id, {count_words(PT_WORDS)} AS pt, {count_words(EN_WORDS)} AS en,
        length(text) >= 200 AND {count_words(EN_WORDS)} > {count_words(PT_WORDS)} * 1.5 AS ingles FROM documents""",
    "doc_bigrams": f"""WITH {PAIRS} SELECT doc_id, term, n FROM counted""",
    "doc_pii_scan": f"SELECT doc_id, {TAGS} AS categorias FROM documents",
    "conversation_pii_scan": f"SELECT conv_id, turn, {TAGS} AS categorias FROM conversations",
    "term_coverage": f"""WITH {PAIRS}, d AS (SELECT doc_id, {PLAIN('text')} AS t FROM documents),
        bench AS (SELECT unnest(string_split({PLAIN('text')}, ' ')) AS w, generate_subscripts(string_split({PLAIN('text')}, ' '), 1) AS i, item_id FROM benchmark),
        said AS (SELECT DISTINCT a.w || ' ' || b.w AS term FROM bench a JOIN bench b ON a.item_id = b.item_id AND b.i = a.i + 1),
        said_words AS (SELECT DISTINCT w FROM bench),
        vocab AS (SELECT * FROM ({language_group_sql()}) WHERE termo IS NOT NULL),
        others AS (SELECT doc_id, termo, bool_or(g IN (SELECT w FROM said_words)) AS outro FROM (SELECT doc_id, termo, unnest(grupo) AS g FROM vocab) GROUP BY ALL),
        situ AS (SELECT doc_id, CASE WHEN termo IN (SELECT w FROM said_words) THEN 'coberto' WHEN outro THEN 'sinonimo' ELSE 'ausente' END AS s FROM others
          UNION ALL SELECT doc_id, CASE WHEN term IN (SELECT term FROM said) THEN 'coberto' ELSE 'ausente' END FROM counted)
        SELECT doc_id AS id, count(*) FILTER (WHERE s = 'coberto') AS cobertos, count(*) FILTER (WHERE s = 'sinonimo') AS sinonimos,
          count(*) FILTER (WHERE s = 'ausente') AS ausentes FROM situ GROUP BY 1""",
    "judgement_staleness": f"""SELECT substr(sha1(nullif({collapsed('text')}, '')), 1, 12) AS impressao, count(*) AS julgamentos, max(quality) AS melhor, max(toxic) AS toxico
        FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
    "latest_status": f"WITH {CURRENT} SELECT id, status FROM current_status",
    "status_transitions": f"""WITH {EVENTS}, t AS (SELECT id, para, lag(para) OVER (PARTITION BY id ORDER BY em, seq) AS de FROM board_events)
        SELECT de, para, count(*) AS n FROM t WHERE de IS NULL OR de <> para GROUP BY ALL""",
    "status_events": f"""WITH {EVENTS}, t AS (SELECT id, seq, para, lag(para) OVER (PARTITION BY id ORDER BY em, seq) AS de FROM board_events)
        SELECT id, seq, de, para FROM t WHERE de IS NULL OR de <> para""",
    "last_five": f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY em DESC, seq DESC) AS rn FROM board_events)
        SELECT id, string_agg(para, '>' ORDER BY rn DESC) AS historico FROM r WHERE rn <= 5 GROUP BY id""",
    "status_as_of": f"""WITH {EVENTS} SELECT id, arg_max(para, (em, seq)) AS status FROM board_events WHERE em <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY id""",
    "unicode_names": """WITH d AS (SELECT doc_id, CAST(doc_id % 11172 AS INTEGER) AS i FROM documents), n AS (
          SELECT doc_id, 'cao ' || chr(4352 + i // 588) || chr(4449 + (i % 588) // 28) || CASE WHEN i % 28 > 0 THEN chr(4519 + i % 28) ELSE '' END || chr(32701) AS normal FROM d)
        SELECT doc_id, normal, normal AS por_sql FROM n""",
    "status_at_each": f"""WITH {EVENTS}, p AS (SELECT id, seq AS evento, em - INTERVAL 12 HOUR AS antes FROM board_events)
        SELECT evento, arg_max(e.para, (e.em, e.seq)) AS vigente_para, arg_max(e.seq, (e.em, e.seq)) AS vigente_seq
        FROM p LEFT JOIN board_events e ON e.id = p.id AND e.em <= p.antes GROUP BY evento""",
    "status_counts": f"""WITH {CURRENT}, dim AS (SELECT * FROM (VALUES ('Avaliar', 0), ('Aplicar', 1), ('Já apliquei', 2), ('Entrevista', 3), ('Cancelada', 4)) v(status, ordem))
        SELECT dim.status, ordem, count(c.id) AS n FROM dim LEFT JOIN current_status c USING (status) GROUP BY ALL""",
    "board_summary": f"""WITH {CURRENT} SELECT count(*) AS total, count(*) FILTER (WHERE status IN {CONCLUDED}) AS concluidas, count(*) FILTER (WHERE status = 'Avaliar') AS n_0,
        count(*) FILTER (WHERE status = 'Aplicar') AS n_1, count(*) FILTER (WHERE status = 'Já apliquei') AS n_2, count(*) FILTER (WHERE status = 'Entrevista') AS n_3,
        count(*) FILTER (WHERE status = 'Cancelada') AS n_4 FROM current_status""",
    "daily_balance": f"""WITH {EVENTS}, f AS (SELECT id, min(em) AS em FROM board_events WHERE para = 'Já apliquei' GROUP BY 1),
        p AS (SELECT CAST(em AS DATE) AS dia, count(*) AS novas FROM f GROUP BY 1),
        spine AS (SELECT CAST(unnest(generate_series((SELECT min(dia) FROM p), (SELECT max(dia) FROM p), INTERVAL 1 DAY)) AS DATE) AS dia)
        SELECT CAST(dia AS VARCHAR) AS dia, coalesce(novas, 0) AS novas, sum(coalesce(novas, 0) - 10) OVER (ORDER BY dia) AS saldo FROM spine LEFT JOIN p USING (dia)""",
    "running_value": """SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS acumulado FROM events""",
    # The zone has no daylight saving time in the months of the log, so its offset is fixed.
    "local_day_counts": "SELECT CAST(CAST(ts - INTERVAL 3 HOUR AS DATE) AS VARCHAR) AS dia, count(*) AS n FROM events GROUP BY 1",
    "event_props": """SELECT CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS INTEGER) AS k, true AS sem_campo, count(*) AS n FROM events GROUP BY 1""",
    "task_effects": """WITH a AS (SELECT 't:' || CAST(user_id AS VARCHAR) AS i1, 'alias:' || regexp_extract(props, '"k":\\s*(\\d+)', 1) AS i2, event_type = 'purchase' AS certain
          FROM events WHERE event_type IN ('purchase', 'error')),
        ids AS (SELECT i1 AS id, certain FROM a UNION ALL SELECT i2, certain FROM a),
        per AS (SELECT id, bool_and(certain) AS certain FROM ids GROUP BY 1),
        t AS (SELECT o_orderkey, bool_and(p.certain) AS certain FROM orders LEFT JOIN per p
            ON p.id = 't:' || CAST(o_orderkey AS VARCHAR) OR p.id = 'alias:' || CAST(o_custkey AS VARCHAR) GROUP BY 1)
        SELECT CASE WHEN certain IS NULL THEN 'reservada' WHEN certain THEN 'enviada' ELSE 'envio_incerto' END AS estado, count(*) AS n FROM t GROUP BY 1""",
    "turn_chain_check": """SELECT conv_id, turn, coalesce(CASE WHEN turn > 0 THEN turn END, -1) = coalesce(lag(turn + 1) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS ok FROM conversations""",
    "revision_chain": """SELECT c.conv_id AS task_id, c.turn + 1 AS revisao, CASE WHEN c.turn = 0 THEN true ELSE c.role <> 'system' AND p.turn IS NOT NULL END AS ok
        FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""",
    "answer_checks": f"""WITH r AS (SELECT conv_id * 1000 + turn AS ord, role, text, nullif(regexp_replace(regexp_replace({nt("role || ' ' || array_to_string(string_split(text, ' ')[1:2], ' ')")}, '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'), '') AS k FROM conversations),
        f AS (SELECT *, min(ord) OVER (PARTITION BY k) AS primeiro, {rx(nt('text'), META_TEXT)} AS meta, regexp_matches(text, '\\b\\d{{3}}\\.\\d{{3}}\\.\\d{{3}}-\\d{{2}}\\b|\\b\\d{{11}}\\b') AS doc, trim(text) = '' AS vazio FROM r)
        SELECT ord, concat_ws('|', CASE WHEN vazio THEN 'resposta deve ser texto final não vazio ou null' END,
            CASE WHEN meta THEN 'resposta contém instrução ou resumo, não texto final' END,
            CASE WHEN doc THEN 'possível documento no texto; retirar e conferir na fonte privada' END) AS erros,
          concat_ws('|', CASE WHEN k IS NOT NULL AND ord > primeiro THEN 'chave equivalente já existe; conferir contexto antes de reutilizar' END,
            CASE WHEN role = 'system' THEN 'conferir se a resposta pessoal deveria ficar somente na fonte privada' END) AS avisos,
          false AS pronta FROM f""",
    "snapshot_validation": """WITH p AS (SELECT *, lag(turn + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
        v AS (SELECT conv_id, 'status desconhecido' AS motivo FROM conversations WHERE role = 'system'
          UNION ALL SELECT conv_id, 'paginação incompleta' FROM p WHERE coalesce(prev, 0) <> turn
          UNION ALL SELECT conv_id, 'idExterno duplicado' FROM (SELECT conv_id, substr(sha1(text), 1, 12) AS s, count(*) AS n FROM conversations GROUP BY ALL) WHERE n > 1)
        SELECT conv_id AS snapshot_id, motivo, count(*) AS n FROM v GROUP BY ALL""",
}

STREAM_ORACLES = {
    "stream_daily_counts": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dia, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_rolling_counts": """WITH d AS (SELECT CAST(ts AS DATE) AS dia, count(*) AS n FROM events GROUP BY 1),
        o AS (SELECT unnest(generate_series(0, 6)) AS k)
        SELECT CAST(dia + CAST(k AS INTEGER) AS VARCHAR) AS ate, CAST(sum(n) AS BIGINT) AS n FROM d, o GROUP BY 1""",
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS novo FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(novo) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS inicio, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_status_fold": f"""WITH {CURRENT} SELECT coalesce(c.status, 'Avaliar') AS status, count(*) AS n FROM orders o LEFT JOIN current_status c ON c.id = CAST(o.o_orderkey AS VARCHAR) GROUP BY 1""",
    "stream_upsert": f"""WITH {POSTINGS} SELECT fonte, publicada_em < TIMESTAMP '1997-12-02 00:00:00' AS atrasada, count(*) AS n FROM postings GROUP BY 1, 2""",
    "cache_rounds": f"""WITH {POSTINGS}, merged AS (SELECT * REPLACE (descricao || CASE WHEN seq % 3 = 0 THEN ' (nova)' ELSE '' END AS descricao) FROM postings WHERE seq % 2 = 0 OR seq % 3 = 0),
          j AS (SELECT *, {reason()} AS reason FROM merged)
        SELECT fonte, CASE WHEN seq % 2 = 0 THEN '2001-08-01' ELSE '2001-08-02' END AS encontrada, seq % 3 = 0 AS editada, count(*) AS n
        FROM j WHERE reason IS NULL GROUP BY 1, 2, 3""",
    "snapshot_replace": f"""WITH {KEYED}, {BOARD} SELECT status, count(*) AS n, CAST(2 AS BIGINT) AS aceitos, '2001-08-02T10:00:00' AS consultado_em
        FROM board WHERE id LIKE 'manual:%' GROUP BY 1""",
    "stream_status_history": f"""WITH {EVENTS}, m AS (SELECT e.*, o.o_orderkey IS NOT NULL AS existe FROM board_events e LEFT JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = e.id),
        l AS (SELECT *, CASE WHEN existe THEN coalesce(lag(para) OVER (PARTITION BY id ORDER BY em, seq), 'Avaliar') END AS de FROM m)
        SELECT CASE WHEN existe THEN 'evento' ELSE 'rejeitada' END AS tipo, de, para, count(*) AS n FROM l WHERE NOT existe OR de <> para GROUP BY ALL""",
    "stream_day_quota": """WITH e AS (SELECT *, CAST(ts - INTERVAL 3 HOUR AS DATE) AS dia FROM events),
        r AS (SELECT user_id, dia, min(ts) AS em FROM e WHERE event_type = 'signup' GROUP BY ALL),
        c AS (SELECT e.user_id, e.dia, arg_min(event_id, (ts, event_id)) AS run FROM e JOIN r ON r.user_id = e.user_id AND r.dia = e.dia AND e.ts >= r.em WHERE event_type = 'purchase' GROUP BY ALL)
        SELECT r.user_id AS instalacao, CAST(r.dia AS VARCHAR) AS dia, CAST(c.run AS VARCHAR) AS run_id FROM r LEFT JOIN c USING (user_id, dia)""",
    "stream_fingerprints": """WITH l AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS antes FROM events)
        SELECT CAST(user_id AS VARCHAR) AS id_externo, count(*) AS n FROM l WHERE antes <> event_type GROUP BY 1""",
    "stream_attempt_ledger": """WITH i AS (SELECT user_id, min(ts) AS em FROM events WHERE event_type = 'click' GROUP BY 1),
        p AS (SELECT e.user_id, arg_min(event_id, (ts, event_id)) AS prova FROM events e JOIN i ON i.user_id = e.user_id AND e.ts >= i.em WHERE event_type = 'purchase' GROUP BY 1)
        SELECT CAST(i.user_id AS VARCHAR) AS chave, CAST(p.prova AS VARCHAR) AS prova, CASE WHEN p.prova IS NULL THEN 'envio_incerto' ELSE 'enviada' END AS estado FROM i LEFT JOIN p USING (user_id)""",
}

DAY = "strftime(publicada_em, '%Y-%m-%d') AS publicada"
PLACE = "CASE WHEN modelo = 'remoto' THEN 'Remote' WHEN modelo IS NULL THEN 'Worldwide' ELSE " + NATION_PLACE + " END"
OF_INTEREST = (f"({any_of(has(nt('titulo'), k) for k in KW.title_weights)} AND NOT "
               f"{any_of(term(nt('titulo'), k) for k in KW.title_excluded + KW.role_excluded)})")
ENTERS = "(modelo = 'remoto' OR modelo IS NULL OR pais IN ('NATION_0', 'NATION_1', 'NATION_2'))"


def provider(source, name, link, key, titulo="titulo", empresa="empresa", date="NULL", only="true"):
    """A provider feed: one job per link, of interest, that accepts the region; ``only`` says which postings it carries."""
    return f"""WITH {KEYED}, f AS (SELECT *, {link} AS l, {key} AS k, {titulo} AS t, {PLACE} AS p FROM keyed WHERE {only}),
      d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS rn FROM f)
      SELECT {q(source + ':')} || substr(sha1(k || '|' || {nt('t')}), 1, 12) AS id_externo, {q(name)} AS fonte, t AS titulo, {empresa} AS empresa, l AS link,
        p AS pais, CASE WHEN p = 'Remote' THEN 'remoto' END AS modelo, {date} AS publicada FROM d WHERE rn = 1 AND {OF_INTEREST} AND {ENTERS}"""


def jobs_in_turn(*sources):
    """Provider jobs of postings that are dealt to the sources in turn: per source its name, link, and what differs from a plain job."""
    usual = dict(title="titulo", company="empresa", location="pais", description="NULL", day="strftime(publicada_em, '%Y-%m-%d')", de="NULL", ate="NULL",
                 moeda="NULL", only="true")
    parts = []
    for n, (source, link, given) in enumerate(sources):
        x = {**usual, **given}
        parts.append(f"""SELECT {q(source)} AS source, {x['title']} AS title, {link} || CAST(seq AS VARCHAR) || {x.get('after', "''")} AS url, {x['company']} AS company,
          {x['location']} AS location, CAST({x['description']} AS VARCHAR) AS description, CAST({x['day']} AS VARCHAR) AS publicada,
          CAST({x['de']} AS DOUBLE) AS de, CAST({x['ate']} AS DOUBLE) AS ate, CAST({x['moeda']} AS VARCHAR) AS moeda
          FROM postings WHERE seq % {len(sources)} = {n} AND {x['only']}""")
    return f"WITH {POSTINGS} " + " UNION ALL ".join(parts)


IS_REMOTE = "coalesce(modelo = 'remoto', false)"
NO_DAY, ACME = {"day": "NULL"}, {"company": "'Acme'"}


def and_remote(place, sep=", "):
    return f"{place} || CASE WHEN {IS_REMOTE} THEN '{sep}Remote' ELSE '' END"


FEED_ORACLES = {
    "feed_json_jobs": jobs_in_turn(
        ("remotli", "'https://remotli.ch/jobs/p-'", dict(location="pais || '; Remote'", de="least(seq % 90, 50)", ate="greatest(seq % 90, 50)", moeda="'USD'",
                                                         description="descricao", only=IS_REMOTE)),
        ("jobicy", "'https://jobicy.com/j/'", {}),
        ("torre", "'https://torre.ai/post/job-'", dict(location=f"CASE WHEN {IS_REMOTE} THEN 'Remote — ' || pais ELSE pais END")),
        ("remoteok", "'https://remoteok.com/'", NO_DAY), ("workingnomads", "'https://w.com/'", NO_DAY),
        ("himalayas", "'https://himalayas.app/j/'", dict(location="pais || ', Chile'")),
        ("getonbrd", "'https://www.getonbrd.com/j/'", dict(location=f"CASE WHEN {IS_REMOTE} THEN 'Remote' ELSE pais END")),
        ("landingjobs", "'https://landing.jobs/at/acme-co/'", dict(company="'Acme Co'", location=and_remote("pais || ', BR'"))),
        ("wttj", "'https://www.welcometothejungle.com/en/companies/acme/jobs/'", dict(location=and_remote("pais || ', BR'"), de="1000 + seq % 7", ate="1000 + seq % 7", moeda="'EUR'")),
        ("4dayweek", "'https://4dayweek.io/job/p-'", dict(location=and_remote("pais || ', BR'"), only="seq % 4 <> 2")),
        ("bamboohr", "'https://feed.example.com/careers/'", {**ACME, **NO_DAY, "location": and_remote("pais || ', SP'")}),
        ("breezy", "'https://a.breezy.hr/p/'", {**ACME, "location": and_remote("pais || ', Brazil'")}),
        ("gem", "'https://jobs.gem.com/acme/'", {**ACME, "location": and_remote("pais", " · "), "description": "descricao"}),
        ("workable", "'https://apply.workable.com/j/'", {**ACME, "location": "pais || ', BR'", "description": "descricao"}),
        ("rippling", "'https://ats.rippling.com/a/'", {**ACME, **NO_DAY}),
        ("a16z-speedrun-talent", "'https://speedrun-talent-network.com/'", dict(location=and_remote("pais"))),
        ("workday", "'https://feed.example.com/job/X/Role_JR-'", {**ACME, "day": "'2001-07-30'"})),
    "feed_markup_jobs": jobs_in_turn(
        ("cryptocurrencyjobs", "'https://c.com/'", dict(location="'Remote'", description="descricao")), ("nodesk", "'https://nodesk.co/'", dict(location="''")),
        ("jobspresso", "'https://jobspresso.co/'", {}), ("jobvite", "'https://a.com/'", {**ACME, "title": "titulo || ' & UI'"}),
        ("personio", "'https://feed.example.com/job/'", {**ACME, "location": "pais || ', RJ'"}),
        ("teamtailor", "'https://a.teamtailor.com/'", {**ACME, "location": "pais || ', Brazil'"}),
        ("join", "'https://join.com/companies/acme/jobs/'", {**ACME, **NO_DAY}),
        ("generalist-world", "'https://generalist.world/jobs/'", {**NO_DAY, "after": "'/'", "location": "'LATIN AMERICA'", "description": "descricao"})),
    "feed_gupy": f"WITH {POSTINGS} SELECT 'gupy:' || CAST(seq AS VARCHAR) AS id_externo, 'Gupy' AS fonte, titulo, empresa, link, pais, modelo, {DAY} FROM postings",
    "feed_arc": f"""WITH {POSTINGS} SELECT 'arc:' || CAST(seq AS VARCHAR) AS id_externo, 'Arc' AS fonte, titulo, empresa,
        'https://arc.dev/remote-jobs/details/job-' || CAST(seq AS VARCHAR) AS link, CASE WHEN pais = 'NATION_0' THEN 'Brasil' END AS pais, 'remoto' AS modelo, {DAY}
        FROM postings WHERE fonte <> 'Arc' AND (pais = 'NATION_0' OR coalesce(modelo = 'remoto', false))""",
    "feed_ux_remote_talent": f"""WITH {POSTINGS} SELECT 'uxremotetalent:' || CAST(seq AS VARCHAR) AS id_externo, titulo, empresa, 'Full-time' AS contrato,
        CASE WHEN modelo = 'remoto' THEN 'Anywhere in the World' WHEN pais = 'NATION_0' THEN 'Brazil Only' ELSE 'Somewhere' END AS restricao_pais, {DAY}, true AS descricao_pendente
        FROM postings WHERE coalesce(modelo = 'remoto', false) OR pais <> 'NATION_1'""",
    "feed_linkedin": f"""WITH {POSTINGS} SELECT 'linkedin:9' || lpad(CAST(seq AS VARCHAR), 11, '0') AS id_externo, titulo, CASE WHEN modelo IS NOT NULL THEN true END AS remoto,
        'Brasil' AS pais, CASE WHEN fonte = 'Gupy' THEN 'junior' END AS senioridade,
        CASE WHEN modelo IS NOT NULL THEN '2001-07-19' ELSE strftime(publicada_em, '%Y-%m-%d') END AS publicada, 8100.0 AS de, 10000.0 AS ate, 'mes' AS periodo FROM postings""",
    "feed_mapped_import": f"""WITH {KEYED}, x AS (SELECT *, modelo IS DISTINCT FROM 'remoto' AS por_link,
          CASE WHEN modelo = 'remoto' THEN CAST(seq AS VARCHAR) ELSE 'url-' || chave_link END AS k FROM keyed),
        d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS rn FROM x)
        SELECT por_link, pais AS localizacao, count(*) AS n, count(*) AS com_data FROM d WHERE rn = 1 GROUP BY ALL""",
    "feed_remotive": provider("remotive", "Remotive", "link", "chave_link"),
    "feed_weworkremotely": provider("weworkremotely", "We Work Remotely", "'https://weworkremotely.com/jobs/' || CAST(seq AS VARCHAR)",
                                    "'weworkremotely.com/jobs/' || CAST(seq AS VARCHAR)", date="strftime(publicada_em, '%Y-%m-%d')"),
    "feed_workable_markdown": provider("workable", "Workable", "'https://apply.workable.com/acme/j/' || CAST(seq AS VARCHAR)",
                                       "'apply.workable.com/acme/j/' || CAST(seq AS VARCHAR)"),
    "feed_hackernews": provider("hackernews", "Hacker News Who is hiring", "'https://jobs.example.com/' || CAST(seq AS VARCHAR)",
                                "'jobs.example.com/' || CAST(seq AS VARCHAR)", titulo=f"empresa || ' | ' || titulo || ' | ' || {PLACE} || ' |'",
                                date="strftime(publicada_em, '%Y-%m-%d')", only="seq % 9 > 1"),
    "feed_seven_boards": " UNION ALL ".join(
        "SELECT * FROM (" + provider(source, name, "link", "chave_link", empresa="'Acme'", only=f"seq % 7 = {n}",
                                     date="strftime(publicada_em, '%Y-%m-%d')" if dated else "CAST(NULL AS VARCHAR)") + ")"
        for n, (source, name, dated) in enumerate((
            ("themuse", "The Muse", False), ("greenhouse", "Greenhouse", True), ("lever", "Lever", True), ("ashby", "Ashby", True),
            ("recruitee", "Recruitee", False), ("pinpoint", "Pinpoint", False), ("comeet", "Comeet", True)))),
    "round_state": "WITH " + CLUSTERS.replace(POSTINGS, "base AS (" + POSTINGS.removeprefix("postings AS (") + f""", postings AS (
          SELECT * REPLACE ('gupy:' || CAST(seq AS VARCHAR) AS id_externo, 'Gupy' AS fonte) FROM base WHERE ({reason()}) IS NULL)""") + """
        SELECT p.id_externo AS id, 'Avaliar' AS status, p.titulo, p.empresa, (SELECT count(*) FROM base) AS lidas, CAST(0 AS BIGINT) AS novas_depois
        FROM clusters c JOIN postings p ON p.id_externo = c.cluster WHERE c.id_externo = c.cluster""",
    "landing_rounds": f"""WITH {POSTINGS} SELECT CASE WHEN seq % 2 = 0 THEN '2001-08-01' ELSE '2001-08-02' END AS encontrada,
          seq % 2 <> 0 OR seq % 3 = 0 AS editada, count(*) AS n, (SELECT count(*) FILTER (WHERE seq % 2 = 0) FROM postings) AS lidas_1,
          (SELECT count(*) FILTER (WHERE seq % 2 <> 0 OR seq % 3 = 0) FROM postings) AS lidas_2, CAST(0 AS BIGINT) AS lidas_3 FROM postings GROUP BY 1, 2""",
    "feed_deep_ld_json": f"""WITH {POSTINGS} SELECT 'https://p/' || CAST(seq // 20 AS VARCHAR) AS url,
          CAST(row_number() OVER (PARTITION BY seq // 20 ORDER BY seq) - 1 AS BIGINT) AS pos, titulo, link FROM postings""",
    "feed_office_tree": f"""WITH {POSTINGS} SELECT 'b' || CAST(seq // 500 AS VARCHAR) AS entry, CAST(seq AS VARCHAR) AS job_id, 'Office ' || CAST(seq % 10 AS VARCHAR) AS offices FROM postings""",
    "feed_counters": f"""WITH {POSTINGS} SELECT 'remotive' AS source, count(*) AS consultadas, count(*) FILTER (WHERE modelo IN ('remoto', 'hibrido')) AS falhas,
        'JSON invalido' AS erro FROM postings""",
}

MORE_ORACLES = {
    "signal_counts": f"WITH {SCORED} SELECT id_externo, {listed('achados')} AS sinais FROM scored",
    "dataset_counters": f"""WITH {POSTINGS} SELECT count(*) AS brutas, count(modelo) AS normalizadas, 0 AS sem_data, count(*) - count(modelo) AS sem_link FROM postings""",
    "source_counters": """SELECT 's' || CAST(l_suppkey AS VARCHAR) AS fonte, count(*) AS consultadas, sum(l_linenumber) AS brutas,
        count(*) FILTER (WHERE l_returnflag = 'R') AS falhas, max(CASE WHEN l_returnflag = 'R' THEN 'HTTP 500' END) AS erro FROM lineitem GROUP BY 1""",
    "facet_coverage": """WITH f AS (SELECT l_suppkey AS listagem, 'retorno' AS faceta, l_returnflag AS v, count(*) FILTER (WHERE l_quantity < 30) AS n FROM lineitem GROUP BY ALL
          UNION ALL SELECT l_suppkey, 'situacao', l_linestatus, count(*) FILTER (WHERE l_quantity < 30) FROM lineitem GROUP BY ALL),
        p AS (SELECT listagem, faceta, sum(n) AS soma, max(n) AS maior FROM f GROUP BY ALL)
        SELECT listagem, max(soma) AS total_real, 2000 AS total_informado, arg_min(faceta, (maior, faceta)) AS faceta_menor_fatia, max(soma) >= 2000 AS truncada FROM p GROUP BY 1""",
    "stock": """SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS busca, count(*) FILTER (WHERE o_orderstatus = 'F') AS preparar, 0 AS em_revisao,
        count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS pronta, 6000 AS alvo, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) < 6000 AS pode_preparar FROM orders""",
    "send_preconditions": f"""WITH {KEYED}, {JUDGED_WIDE}, {JUDGEMENTS}, {LOOKUP},
        r AS (SELECT g.id_externo, g.reason, g.fonte, b.status_sure, j.id IS NOT NULL AS lida, coalesce(j.toxic = 1, false) AS velho, b.status_sure IS NULL AND b.status_weak IS NOT NULL AS conflito
          FROM judged g JOIN seen b USING (id_externo) LEFT JOIN judgements j ON j.id = g.id_externo),
        m AS (SELECT id_externo, concat_ws('|', CASE WHEN reason IS NOT NULL THEN 'vaga ausente ou barrada pela regra atual' END,
            CASE WHEN status_sure IS DISTINCT FROM 'Aplicar' THEN 'vaga não está em Aplicar na fonte de estado' END,
            CASE WHEN reason IS NULL AND NOT lida THEN 'anúncio ainda não foi lido contra o currículo' END, CASE WHEN velho THEN 'anúncio mudou: releitura necessária' END,
            CASE WHEN conflito THEN 'identidade ambígua: conferir a requisição oficial' END, CASE WHEN fonte = 'Arc' THEN 'controle de transmissão não liberado' END) AS motivos FROM r)
        SELECT id_externo, motivos, motivos = '' AS precondicoes_atendidas FROM m""",
    "import_completeness": """WITH p AS (SELECT conv_id, turn, role = 'system' AS bad, contains(text, chr(10)) AS err, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
        g AS (SELECT conv_id AS fonte, count(*) AS consultadas, count(*) FILTER (WHERE NOT err) AS brutas, count(*) FILTER (WHERE NOT err AND NOT bad) AS importadas,
          count(*) FILTER (WHERE NOT err AND bad) AS invalidas, count(*) FILTER (WHERE err) AS falhas,
          coalesce(max(turn) FILTER (WHERE NOT err) + 1 < any_value(total), false) AS truncada FROM p GROUP BY 1)
        SELECT fonte, consultadas, brutas, importadas, falhas, truncada, CASE WHEN falhas > 0 OR (brutas > 0 AND invalidas = brutas) THEN CASE WHEN importadas > 0 THEN 'parcial' ELSE 'erro' END
          WHEN truncada OR invalidas > 0 THEN 'parcial' WHEN brutas > 0 THEN 'ok' ELSE 'vazia' END AS status FROM g""",
    "page_yield": """WITH c AS (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS cartoes, len(regexp_extract_all(html, '<a href=')) AS usaveis,
          len(regexp_extract_all(html, '<a href="/[a-z]+"')) AS com_local FROM pages)
        SELECT *, (usaveis >= 5 AND com_local * 2 < usaveis) OR (cartoes > 0 AND usaveis = 0) AS layout_suspeito FROM c""",
}

CONTENT_ORACLES["pages_in_sql"] = f"""SELECT page_id, titulo, t.sha1 AS texto, c.sha1 AS limpo, status, viva, data, situacao, url_publica, chave, id_link
    FROM ({CONTENT_ORACLES['page_title']}) JOIN ({CONTENT_ORACLES['page_text']}) t USING (page_id) JOIN ({CONTENT_ORACLES['page_clean_html']}) c USING (page_id)
    JOIN ({CONTENT_ORACLES['page_status']}) USING (page_id) JOIN ({CONTENT_ORACLES['public_urls']}) USING (page_id)"""

ORACLES = {**POSTING_ORACLES, **CONTENT_ORACLES, **STREAM_ORACLES, **FEED_ORACLES, **MORE_ORACLES}
