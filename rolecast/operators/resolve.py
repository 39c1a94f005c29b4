"""Entity resolution across sources (GR-01 … GR-09, JN-06, JN-07).

The published pass is greedy and depends on arrival order; here the result
depends on the data alone:

* D1: a posting that matches only a merged loser joins the same cluster.
* D2: nothing can merge into a posting that is no longer in the output.
* D3: gaps are filled from every member, in priority order, in both directions.
* Weak matches form a star around one posting per announcement instead of a
  chain in arrival order; the same postings are flagged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.config import DEFAULT_KEYWORDS, DEFAULT_PARITY, DEFAULT_PRIORITY, SOURCE_PRIORITY
from rolecast.functions import text, urls
from rolecast.operators.components import component_labels, star_edges
from rolecast.operators.shaping import bind, col_or_null, cut_lineage

# The identity columns, and (fixed values) those filled from the losers when the survivor lacks them.
KEYS = ("chave_link", "chave_requisicao", "chave_anuncio", "requisicao")
GAP_COLUMNS = ("descricao", "salario_bruto", "atualizada_em", "publicada_em", "cidade", "estado", "modelo")


@dataclass(frozen=True)
class Resolution:
    """The outcome of :func:`resolve`.

    ``survivors``: one row per entity, with ``tambem_visto_em`` and ``n_fundidas``.
    ``aliases``: (id_externo, alias) rows, every other id of an entity.
    ``possible_duplicates``: (id_externo, possivel_duplicata) weak matches, strict mode only.
    ``clusters``: (id_externo, cluster) for every posting that shares a key.
    ``merged``: (id_externo, sobrevivente) for every row of an entity of several rows, read from the written keys alone.
    """

    survivors: DataFrame
    aliases: DataFrame
    possible_duplicates: DataFrame
    clusters: DataFrame
    merged: DataFrame


def source_priority(source: Column) -> Column:
    """GR-02: the more direct the link, the higher."""
    table = F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, source), F.lit(DEFAULT_PRIORITY))


def with_identity(df: DataFrame, kw=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY) -> DataFrame:
    """J02: the four strong keys and the weak one, without a shuffle."""
    derived = dict(
        chave_link=F.nullif(urls.normalize_link(F.col("link"), parity), F.lit("")),
        _empresa=text.normalize_text(F.col("empresa")),
        _titulo=text.normalize_text(F.col("titulo")))
    if "id_canonico" not in df.columns:
        derived["id_canonico"] = urls.canonical_id(F.col("link"), F.col("id_externo"))
    df = bind(df, **derived)
    return bind(
        df,
        chave_requisicao=urls.requisition_key(F.col("_empresa"), F.col("titulo"), kw),
        chave_anuncio=urls.announcement_key(F.col("_empresa"), F.col("_titulo"), kw),
        requisicao=urls.requisition(F.col("titulo")),
    ).drop("_empresa", "_titulo")


def _strong_keys() -> Column:
    kinds = {"c": "id_canonico", "l": "chave_link", "r": "chave_requisicao"}
    return F.array_compact(F.array(*[F.concat(F.lit(k + ":"), F.col(c)) for k, c in kinds.items()]))


def identity_members(postings: DataFrame, kw=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY) -> DataFrame:
    """(node, key): every strong key of every posting; a posting without keys has one row."""
    return with_identity(postings, kw, parity).select(F.col("id_externo").alias("node"), F.explode_outer(_strong_keys()).alias("key"))


def identity_edges(keyed: DataFrame, strict: bool = True) -> DataFrame:
    """JN-06: one star per shared key; the weak key only links in loose mode."""
    members = keyed.select(F.col("id_externo").alias("node"), F.explode(_strong_keys()).alias("key"))
    edges = star_edges(members, "node", "key")
    return edges if strict else edges.unionByName(_weak_edges(keyed)).distinct()


def _weak_edges(keyed: DataFrame) -> DataFrame:
    """JN-07: same announcement and no conflicting requisition, as a star.

    A posting without a requisition conflicts with none, so the smallest such
    posting of an announcement can stand for all of them.  Postings that carry
    a requisition and share it are linked by the strong key already.
    """
    # Announcements begin with the company, so a hash in front spares comparing them whole.
    hashed = keyed.filter("chave_anuncio IS NOT NULL").select("id_externo", "chave_anuncio", "requisicao", F.xxhash64("chave_anuncio").alias("_h"))
    centers = hashed.filter("requisicao IS NULL").groupBy("_h", "chave_anuncio").agg(F.min("id_externo").alias("center"))
    joined = hashed.join(centers, ["_h", "chave_anuncio"]).filter("id_externo <> center")
    return joined.select(
        F.greatest("id_externo", "center").alias("u"), F.least("id_externo", "center").alias("v")).distinct()


def _election_order(seq: Column) -> Column:
    return F.struct((-source_priority(F.col("fonte"))).alias("p"), seq.alias("s"), F.col("id_externo").alias("i"))


def resolve(postings: DataFrame, strict: bool = True, kw=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY) -> Resolution:
    """GR-01 … GR-07: postings (with an arrival order ``seq``) to entities."""
    known = postings.filter("id_externo IS NOT NULL")
    if "id_canonico" not in known.columns:
        known = bind(known, id_canonico=urls.canonical_id(F.col("link"), F.col("id_externo")))
    # The keys cost many patterns per row and are read several times, so they are written once, with what the election
    # looks at; the postings themselves, with their text, are not.
    keyed = cut_lineage(with_identity(known.withColumn("seq", col_or_null(known, "seq", "bigint")), kw, parity).select(
        "id_externo", "id_canonico", "fonte", "seq", *KEYS))
    labels = cut_lineage(component_labels(identity_edges(keyed, strict)).select(
        F.col("node").alias("id_externo"), F.col("label").alias("cluster")), "labels")
    # Postings that share no key and no id are their own survivors, without an aggregate over their texts.
    # The groups are the labelled ids and the ids that stand twice.
    repeated = keyed.groupBy("id_externo").agg(F.count("*").alias("n")).filter("n > 1").select(
        "id_externo", F.col("id_externo").alias("cluster"))
    grouped = labels.unionByName(repeated.join(labels.select("id_externo"), "id_externo", "left_anti"))
    elected = elect(known.join(grouped, "id_externo"))
    survivors = elected.unionByName(_lone(known.join(grouped.select("id_externo"), "id_externo", "left_anti")))
    # Who was elected, and under which keys, follows from the written keys; only ``survivors`` needs the postings.
    members = cut_lineage(keyed.join(grouped, "id_externo", "left").withColumn("_h", F.xxhash64("cluster")), "members")
    lone, several = members.filter("cluster IS NULL"), members.filter("cluster IS NOT NULL")
    winners = several.groupBy("_h", "cluster").agg(F.min_by(
        F.struct("id_externo", "chave_anuncio", "requisicao"), _election_order(F.col("seq"))).alias("w"))
    winners = cut_lineage(winners.select("_h", "cluster", "w.*"), "winners")
    elected_id = winners.select("_h", "cluster", F.col("id_externo").alias("sobrevivente"))
    merged = several.select("_h", "cluster", "id_externo", "id_canonico").join(elected_id, ["_h", "cluster"])
    aliases = merged.select(F.col("sobrevivente").alias("id_externo"), F.explode(F.array("id_externo", "id_canonico")).alias("alias")).unionByName(
        lone.select("id_externo", F.col("id_canonico").alias("alias"))).filter("alias <> id_externo").distinct()
    judged = winners.select("id_externo", "chave_anuncio", "requisicao").unionByName(lone.select("id_externo", "chave_anuncio", "requisicao"))
    weak = _weak_edges(judged) if strict else _weak_edges(judged.limit(0))
    flagged = weak.select(F.inline(F.array(
        F.struct(F.col("u").alias("id_externo"), F.col("v").alias("possivel_duplicata")),
        F.struct(F.col("v").alias("id_externo"), F.col("u").alias("possivel_duplicata")))))
    return Resolution(survivors, aliases, flagged, labels, merged.select("id_externo", "sobrevivente"))


def _lone(postings: DataFrame) -> DataFrame:
    """What :func:`elect` gives for postings that are alone in their cluster."""
    return postings.select(
        F.col("id_externo").alias("cluster"),
        *[F.when(_present(postings, c), F.col(c)).alias(c) if c in GAP_COLUMNS else F.col(c) for c in postings.columns],
        F.array().cast("array<string>").alias("tambem_visto_em"), F.lit(0).cast("bigint").alias("n_fundidas"))


def elect(labelled: DataFrame) -> DataFrame:
    """GR-02, GR-03, GR-04: one survivor per ``cluster``, its gaps filled.

    Grouped aggregates only: they combine map-side and hold one row per
    cluster, so a cluster of any size is fine.
    """
    seq = col_or_null(labelled, "seq", "bigint")
    order = _election_order(seq)
    gaps = [c for c in GAP_COLUMNS if c in labelled.columns]
    carried = [c for c in labelled.columns if c != "cluster"]
    best = labelled.groupBy("cluster").agg(
        F.min_by(F.struct(*carried), order).alias("best"),
        *[F.min_by(F.col(c), F.when(_present(labelled, c), order)).alias(f"gap_{c}") for c in gaps],
        F.array_sort(F.collect_set("fonte")).alias("fontes"),
        F.count("*").alias("n"))
    columns = [
        (F.when(_present_in(F.col(f"best.{c}"), labelled, c), F.col(f"best.{c}")).otherwise(F.col(f"gap_{c}"))
         if c in gaps else F.col(f"best.{c}")).alias(c)
        for c in carried]
    return best.select(
        "cluster", *columns,
        F.array_except("fontes", F.array("best.fonte")).alias("tambem_visto_em"),
        (F.col("n") - 1).alias("n_fundidas"))


def _present(df: DataFrame, name: str) -> Column:
    return _present_in(F.col(name), df, name)


def _present_in(value: Column, df: DataFrame, name: str) -> Column:
    """An empty string is a gap as well."""
    filled = value.isNotNull()
    return filled & (value != "") if dict(df.dtypes)[name] == "string" else filled


def collisions(resolution: Resolution) -> DataFrame:
    """GR-05: how many rows were merged away."""
    entities = resolution.merged.select("sobrevivente").distinct().agg(F.count("*").alias("entidades"))
    rows = resolution.merged.agg(F.count("*").alias("linhas"))
    return rows.crossJoin(entities).select((F.col("linhas") - F.col("entidades")).alias("colisoes"))


def reconcile(cache: DataFrame, strict: bool = True, kw=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY):
    """GR-06, SET-02: (reconciled cache, ids that lost their own entry)."""
    known = [c for c in cache.columns if c not in ("id_canonico",)]
    result = resolve(cache.select(*known), strict, kw, parity)
    return result.survivors, removed_ids(cache, result)


def removed_ids(cache: DataFrame, resolution: Resolution) -> DataFrame:
    """SET-02: the ids of ``cache``, which was resolved, that lost their own entry."""
    # An id that survives in one of its rows keeps its entry; a row without an id has none to keep.
    lost = resolution.merged.filter("id_externo <> sobrevivente").select("id_externo")
    return lost.unionByName(cache.select("id_externo").filter("id_externo IS NULL")).distinct()


def resolve_aliases(identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR-08: (alias → canonical, conflicts).

    ``identities`` holds (canonico, alias) pairs.  A component with more than
    one canonical id is a conflict: it is reported, not merged.
    """
    canon, alias = F.concat(F.lit("c|"), "canonico"), F.concat(F.lit("a|"), "alias")
    edges = identities.filter("canonico IS NOT NULL AND alias IS NOT NULL").select(
        F.greatest(canon, alias).alias("u"), F.least(canon, alias).alias("v")).distinct()
    labels = component_labels(edges)
    owners = labels.filter(F.col("node").startswith("c|")).groupBy("label").agg(
        F.min("node").alias("first"), F.count("*").alias("n"))
    members = labels.filter(F.col("node").startswith("a|")).join(owners, "label")
    plain = lambda c: F.substr(F.col(c), F.lit(3))
    resolved = members.filter("n = 1").select(plain("node").alias("alias"), plain("first").alias("canonico"))
    conflicts = members.filter("n > 1").select(plain("node").alias("alias"), F.col("n").alias("canonicos"))
    return resolved, conflicts


def union_sources(*frames: DataFrame) -> DataFrame:
    """SET-01: all sources and layers; a column a source lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
