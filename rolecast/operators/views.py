"""Counts, rollups, rankings and set views (AG-*, TOP-*, SET-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.config import BOARD_CONCLUDED, BOARD_STATUSES, DEFAULT_PROFILE
from rolecast.functions import dates
from rolecast.operators import score


def count_by(df: DataFrame, field: str, missing: str = "sem motivo") -> DataFrame:
    """AG-01, AG-02: counts of a field, most frequent first."""
    key = F.coalesce(F.nullif(F.col(field), F.lit("")), F.lit(missing)).alias(field)
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), field)


def run_totals(judged: DataFrame) -> DataFrame:
    """AG-03: the totals of a run in one pass.

    Expects ``reason``, ``lida``, ``concluida``, ``no_notion`` and ``nova`` on every posting.
    """
    ok = F.col("reason").isNull()
    open_ = ok & ~F.coalesce("concluida", F.lit(False))
    read = F.coalesce("lida", F.lit(False))
    return judged.agg(
        F.count("*").alias("unicas"),
        F.count_if(ok).alias("aprovadas"),
        F.count_if(~ok).alias("descartadas"),
        F.count_if(ok & F.coalesce("nova", F.lit(False))).alias("novas_no_cache"),
        F.count_if(open_ & read).alias("lidas"),
        F.count_if(open_ & ~read).alias("aguardando_leitura"),
        F.count_if(ok & F.coalesce("concluida", F.lit(False))).alias("concluidas"),
        F.count_if(open_ & F.coalesce("no_notion", F.lit(False))).alias("ja_no_quadro"),
        F.count_if(F.coalesce(F.col("reason") == "inscricoes encerradas", F.lit(False))).alias("encerradas"),
        F.count_if(F.coalesce(F.col("reason").startswith("zumbi"), F.lit(False))).alias("zumbis"),
        F.count_if(F.col("publicada_em").isNull()).alias("sem_data"),
        F.count_if(F.col("link").isNull()).alias("sem_link"),
        F.count_if(F.coalesce(F.length("descricao"), F.lit(0)) == 0).alias("sem_descricao"),
    )


def source_counters(pages: DataFrame) -> DataFrame:
    """AG-04: requests, raw items and failures per source, with one sample error.

    ``pages``: (fonte, itens, erro), one row per landed page.
    """
    return pages.groupBy("fonte").agg(
        F.count("*").alias("consultadas"),
        F.coalesce(F.sum("itens"), F.lit(0)).alias("brutas"),
        F.count_if(F.col("erro").isNotNull()).alias("falhas"),
        F.min("erro").alias("erro"))


def import_rollup(counters: DataFrame) -> DataFrame:
    """AG-05: import counters per source and in total, with the status of each.

    ``counters``: (fonte, consultadas, brutas, falhas, importadas, invalidas,
    duplicadas, truncada, completa, desativada).
    """
    active = ~F.coalesce("desativada", F.lit(False))
    sums = [F.sum(c).alias(c) for c in ("consultadas", "brutas", "falhas", "importadas", "invalidas", "duplicadas")]
    rolled = counters.rollup("fonte").agg(
        *sums,
        F.bool_or("truncada").alias("truncada"),
        (F.count_if(active) > 0).alias("_any"),
        F.coalesce(F.bool_and(F.when(active, F.col("completa"))), F.lit(False)).alias("completa"),
        F.grouping_id().alias("_level"))
    status = (
        F.when(~F.col("_any"), "desativada")
        .when(F.col("completa") & (F.col("brutas") > 0), "ok")
        .when(F.col("completa"), "vazia")
        .when(F.col("importadas") > 0, "parcial")
        .otherwise("erro"))
    return rolled.withColumn("status", status).withColumn(
        "fonte", F.when(F.col("_level") == 1, F.lit("TOTAL")).otherwise(F.col("fonte"))).drop("_any", "_level")


def board_counts(board: DataFrame) -> DataFrame:
    """AG-06: cards per status; the board's own columns appear even when empty."""
    spark = board.sparkSession
    dim = spark.createDataFrame([(s, i) for i, s in enumerate(BOARD_STATUSES)], "status string, ordem int")
    counts = board.groupBy("status").agg(F.count("*").alias("n"))
    return counts.join(dim, "status", "full").select(
        "status", F.coalesce("ordem", F.lit(len(BOARD_STATUSES))).alias("ordem"), F.coalesce("n", F.lit(0)).alias("n"))


def board_summary(board: DataFrame) -> DataFrame:
    """AG-07: total, concluded, and the count per status."""
    concluded = F.col("status").isin(*BOARD_CONCLUDED)
    return board.agg(
        F.count("*").alias("total"), F.count_if(concluded).alias("concluidas"),
        *[F.count_if(F.col("status") == s).alias(f"n_{i}") for i, s in enumerate(BOARD_STATUSES)])


def queue_histogram(queue: DataFrame) -> DataFrame:
    """AG-08: the reading queue by the band of its ceiling."""
    return queue.groupBy(score.ceiling_band(F.col("teto")).alias("faixa")).agg(F.count("*").alias("n"))


def queue_gaps(queue: DataFrame) -> DataFrame:
    """AG-09: queue rows with too little to read, and rows whose ad was edited."""
    return queue.agg(
        F.count("*").alias("fila"),
        F.count_if(F.coalesce(F.length("descricao"), F.lit(0)) < 200).alias("sem_descricao"),
        F.count_if(F.coalesce("julgamento_desatualizado", F.lit(False))).alias("reeditadas"))


def facet_coverage(facets: DataFrame, clamp: int = 2000) -> DataFrame:
    """AG-10: per listing the facet that covers most, its sum as the true total.

    ``facets``: (listagem, faceta, valor, quantidade, total_informado).
    """
    per_facet = facets.groupBy("listagem", "faceta").agg(
        F.sum("quantidade").alias("soma"), F.max("quantidade").alias("maior"),
        F.max("total_informado").alias("total_informado"))
    return per_facet.groupBy("listagem").agg(
        F.max("soma").alias("total_real"), F.max("total_informado").alias("total_informado"),
        F.min_by("faceta", F.struct("maior", "faceta")).alias("faceta_menor_fatia"),
    ).withColumn("truncada", (F.col("total_informado") == clamp) & (F.col("total_real") >= clamp))


def signal_counts(scored: DataFrame) -> DataFrame:
    """AG-13: distinct signal groups per posting."""
    return scored.select("id_externo", F.size("score.sinais_achados").alias("sinais"))


def daily_balance(new_ids_per_day: DataFrame, quota: int = 10, start: int = 0) -> DataFrame:
    """AG-14: running credit or debit, checked every day of the calendar.

    ``new_ids_per_day``: (dia date, novas).  The spine fills days without any;
    the window runs over one row per calendar day.
    """
    bounds = new_ids_per_day.agg(F.min("dia").alias("a"), F.max("dia").alias("b"))
    spine = bounds.filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("dia"))
    daily = spine.join(new_ids_per_day, "dia", "left").withColumn("novas", F.coalesce("novas", F.lit(0)))
    running = Window.orderBy("dia").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("saldo", F.lit(start) + F.sum(F.col("novas") - quota).over(running))


def balance_check(known: DataFrame, current: DataFrame, last_check: Column, today: Column, quota: int = 10,
                  start: int = 0) -> DataFrame:
    """AG-14, SET-03: one check of the balance against the ids counted before."""
    fresh = new_ids(current, known)
    due = dates.elapsed_days(last_check, today) * quota
    return fresh.agg(F.count("*").alias("novas")).select(
        "novas", due.alias("quota_devida"), (F.lit(start) + F.col("novas") - due).alias("saldo"))


def dataset_counters(raw: DataFrame, normalized: DataFrame) -> DataFrame:
    """AG-15: raw, normalized, without link and without date, of one dataset."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    no_date = F.when(F.col("publicada_em").isNull(), one).otherwise(zero)
    marks = raw.select(one.alias("brutas"), zero.alias("normalizadas"), zero.alias("sem_data")).unionByName(
        normalized.select(zero.alias("brutas"), one.alias("normalizadas"), no_date.alias("sem_data")))
    total = lambda c: F.coalesce(F.sum(c), zero).alias(c)
    return marks.agg(total("brutas"), total("normalizadas"), total("sem_data")).withColumn(
        "sem_link", F.col("brutas") - F.col("normalizadas"))


def source_yield(postings: DataFrame, kept: Column) -> DataFrame:
    """AG-19: per source the raw rows, the useful distinct ones, and the loss."""
    return postings.groupBy("fonte").agg(
        F.count("*").alias("brutas"),
        F.countDistinct(F.when(kept, F.col("id_externo"))).alias("aproveitadas"),
    ).withColumn("perdidas", F.col("brutas") - F.col("aproveitadas"))


def stock(tasks: DataFrame, target: int) -> DataFrame:
    """AG-20: ready packages against the target, and tasks per stage."""
    stages = ["busca", "preparar", "em_revisao", "pronta"]
    counted = tasks.agg(*[F.count_if(F.col("etapa") == s).alias(s) for s in stages])
    return counted.withColumn("alvo", F.lit(target)).withColumn("pode_preparar", F.col("pronta") < target)


def page_yield(rows: DataFrame) -> DataFrame:
    """FLT-27: pages whose layout seems to have changed.

    ``rows``: (fonte, url, cartoes, usaveis, com_local), one row per landed page.
    """
    drift = (
        ((F.col("usaveis") >= 5) & (F.col("com_local") / F.col("usaveis") < 0.5))
        | ((F.col("cartoes") > 0) & (F.col("usaveis") == 0)))
    return rows.withColumn("layout_suspeito", drift)


# ------------------------------------------------------------------------ rankings


def rank_top(df: DataFrame, k: int = 10, by: str = "compatibilidade", tie: str = "id_externo") -> DataFrame:
    """TOP-01, TOP-04: the k best; the id breaks ties."""
    return df.orderBy(F.desc_nulls_last(by), tie).limit(k)


def ranked(df: DataFrame, by: str = "compatibilidade", tie: str = "id_externo") -> DataFrame:
    """TOP-06: the whole list, unknown scores last."""
    return df.orderBy(F.desc_nulls_last(by), tie)


def reading_queue(hydrated: DataFrame, profile=DEFAULT_PROFILE) -> DataFrame:
    """FLT-20, TOP-02: what is worth reading, by how far a reading could lift it."""
    waiting = ~F.coalesce("concluida", F.lit(False)) & (
        ~F.coalesce("lida", F.lit(False)) | F.coalesce("julgamento_desatualizado", F.lit(False)))
    return hydrated.filter(waiting).withColumn(
        "teto", score.reading_ceiling(F.col("score.determinado"), profile))


def brief_candidates(hydrated: DataFrame, minimum: int | None = DEFAULT_PROFILE.brief_from, top: int = 5) -> DataFrame:
    """TOP-03: everything from a score on, else the best few."""
    if minimum is None:
        return rank_top(hydrated, top)
    return ranked(hydrated.filter(F.col("compatibilidade") >= minimum))


# ---------------------------------------------------------------------------- sets


def new_ids(current: DataFrame, known: DataFrame, key: str = "id_externo") -> DataFrame:
    """SET-03: ids not counted before."""
    return current.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def removed_ids(before: DataFrame, after: DataFrame, key: str = "id_externo") -> DataFrame:
    """SET-02: ids that lost their own entry."""
    return before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti")
