"""State tables and their writers (SNK-01 … SNK-10).

Merges are joins that return the next version of a table.  The cache and the external
snapshot are stored in parts that change one by one and become visible in one step;
other writers replace only the date partitions they touch, so a retried job writes the
same files again.  History is append-only and never deleted.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolecast.config import (
    BOARD_EXTRA, BOARD_STATUSES, DEFAULT_KEYWORDS, DEFAULT_PARITY, DEFAULT_PROFILE, INITIAL_STATUS,
)
from rolecast.functions import text
from rolecast.operators import filters
from rolecast.operators.shaping import bind, col_or_null, cut_lineage
from rolecast.operators.versioned import PART, PartTable


def upsert_cache(old: DataFrame, new: DataFrame, now, sparse: tuple = ()) -> DataFrame:
    """SNK-01: the new row replaces the old one; the first-seen stamp is kept.

    Columns named in ``sparse`` keep the old value when the new one is NULL,
    for fields that not every source sets.
    """
    columns = [c for c in dict.fromkeys(old.columns + new.columns) if c not in ("id_externo", "encontrada_em")]
    # Of several new rows of an id the latest stays; equal ones fall back on the content, so the choice is always the same.
    row = F.struct(*[c for c in new.columns if c != "id_externo"])
    fresh = new.groupBy("id_externo").agg(F.max_by(row, _newest(new)).alias("n")).withColumn("_new", F.lit(True))
    kept = old.select(
        "id_externo", F.struct(*[c for c in old.columns if c != "id_externo"]).alias("o"), F.lit(True).alias("_old"))

    def merged(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        if c not in old.columns:
            return F.col(f"n.{c}")
        if c in sparse:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        return F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    stamp = F.when(F.col("_old"), F.col("o.encontrada_em") if "encontrada_em" in old.columns else F.lit(None)).otherwise(
        F.lit(now).cast("timestamp"))
    return kept.join(fresh, "id_externo", "full").select(
        "id_externo", *[merged(c).alias(c) for c in columns], stamp.alias("encontrada_em"))


def _newest(df: DataFrame) -> Column:
    """A full order of an id's rows: by update, publication, place, then content."""
    times = [F.col(c) for c in ("atualizada_em", "publicada_em", "seq") if c in df.columns]
    return F.struct(*times, F.xxhash64(*[F.col(c) for c in df.columns]).alias("_content"))


def expunge(cache: DataFrame, now, profile=DEFAULT_PROFILE, kw=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY):
    """SNK-01: (rows that still pass today's filter, rows that do not, with the reason)."""
    judged = filters.with_reason(cache, now, profile, kw, parity)
    return (
        judged.filter("reason IS NULL").select(*cache.columns),
        judged.filter("reason IS NOT NULL").select("id_externo", "titulo", "fonte", "reason"))


# ----------------------------------------------------------------------------- board


def _snapshot(df: DataFrame) -> list[Column]:
    filled = lambda c: F.nullif(c, F.lit(""))
    return [
        filled(F.col("titulo")).alias("titulo"), filled(F.col("empresa")).alias("empresa"),
        filled(F.col("link")).alias("url"), filled(F.col("fonte")).alias("fonte"),
        col_or_null(df, "compatibilidade", "int").alias("compatibilidade"),
        filled(col_or_null(df, "salario_texto", "string")).alias("salario_texto"),
        F.col("publicada_em").cast("timestamp").alias("publicada_em"),
    ]


def register(board: DataFrame, approved: DataFrame, now):
    """SNK-02: (next board, new history events); running it twice changes nothing.

    ``board``: (id, status, titulo, empresa, url, fonte, compatibilidade,
    salario_texto, publicada_em, registrada_em).
    """
    instant = F.lit(now).cast("timestamp")
    rows = approved.filter("id_externo IS NOT NULL")
    row = F.struct(*[c for c in rows.columns if c != "id_externo"])
    seen = rows.groupBy("id_externo").agg(F.max_by(row, _newest(rows)).alias("r")).select("id_externo", "r.*")
    fresh = seen.select(F.col("id_externo").alias("id"), F.struct(*_snapshot(seen)).alias("s"))
    joined = board.join(fresh, "id", "full")
    is_new = F.col("status").isNull()

    def field(name: str, sticky: bool) -> Column:
        new = F.col(f"s.{name}")
        if sticky:
            return F.coalesce(new, F.col(name)).alias(name)
        return F.when(F.col("s").isNotNull(), new).otherwise(F.col(name)).alias(name)

    nxt = joined.select(
        "id", F.coalesce("status", F.lit(INITIAL_STATUS)).alias("status"),
        field("titulo", True), field("empresa", True), field("url", True), field("fonte", False),
        field("compatibilidade", False), field("salario_texto", False), field("publicada_em", False),
        F.when(is_new, instant).otherwise(F.col("registrada_em")).alias("registrada_em"))
    events = fresh.join(board.select("id"), "id", "left_anti").select(
        "id", instant.alias("em"), F.lit(None).cast("string").alias("de"), F.lit(INITIAL_STATUS).alias("para"),
        F.lit("rodada").alias("por"))
    return nxt, events


def mirror(board: DataFrame, rows: DataFrame) -> DataFrame:
    """SNK-03: external rows replace the status; what they leave out is kept."""
    incoming = rows.filter("id_externo IS NOT NULL").groupBy(F.col("id_externo").alias("id")).agg(
        F.max_by(F.struct("status", "empresa", "titulo", "url"), "ord").alias("r"))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    other = [c for c in board.columns if c not in ("id", "status", "empresa", "titulo", "url")]
    return board.join(incoming, "id", "full").select(
        "id",
        F.when(F.col("r").isNotNull(), F.coalesce(filled("r.status"), F.lit(INITIAL_STATUS)))
        .otherwise(F.col("status")).alias("status"),
        *[F.coalesce(filled(f"r.{c}"), F.col(c)).alias(c) for c in ("empresa", "titulo", "url")], *other)


def apply_moves(board: DataFrame, moves: DataFrame):
    """SNK-04: (next board, events, rejected moves).

    ``moves``: (id, para, por, em, seq).  An unknown status or id is rejected
    with its reason; a move to the status a card has is no event.  Several
    moves of one card chain in the order they were made.
    """
    from rolecast.operators.windows import with_previous

    known = F.col("para").isin(*BOARD_STATUSES, *BOARD_EXTRA)
    tagged = moves.join(board.select("id", F.col("status").alias("_atual")), "id", "left")
    why = (
        F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("status desconhecido: "), F.coalesce("para", F.lit(""))))
        .when(F.col("_atual").isNull(), F.concat(F.lit("vaga nao esta no quadro: "), F.coalesce("id", F.lit("")))))
    judged = tagged.withColumn("motivo", why)
    rejected = judged.filter("motivo IS NOT NULL").select("id", "para", "por", "em", "motivo")
    valid = judged.filter("motivo IS NULL")
    chained = with_previous(valid, "id", ["em", "seq"], ["para"])
    events = (
        chained.withColumn("de", F.coalesce("ant_para", "_atual")).filter("de <> para")
        .select("id", "em", "de", "para", "por"))
    final = valid.groupBy("id").agg(F.max_by("para", F.struct("em", "seq")).alias("_para"))
    nxt = board.join(final, "id", "left").withColumn("status", F.coalesce("_para", "status")).drop("_para")
    return nxt, events, rejected


# ------------------------------------------------------------------------ judgements


def upsert_judgements(stored: DataFrame, new: DataFrame, today, profile=DEFAULT_PROFILE) -> DataFrame:
    """SNK-08: clamp the score, keep the earlier text where the new row has none.

    ``new``: (id, nota, resumo, gaps, impressao, descricao, lido_em, ord).
    """
    latest = new.groupBy("id").agg(F.max_by(F.struct(
        "nota", "resumo", "gaps", "impressao", "descricao", "lido_em"), "ord").alias("n"))
    given = F.coalesce(F.col("n.impressao"), text.fingerprint(F.col("n.descricao")))
    given_note = F.col("n.nota").cast("double")
    # least() and greatest() skip NULL: an absent score must not become the maximum.
    clamped = F.when(given_note.isNotNull(), F.greatest(
        F.lit(0.0), F.least(given_note, F.lit(float(profile.semantic_max)))))
    has = F.col("n").isNotNull()
    return stored.join(latest, "id", "full").select(
        "id",
        F.when(has, clamped).otherwise(F.col("nota")).alias("nota"),
        F.coalesce("n.resumo", "resumo").alias("resumo"),
        F.coalesce("n.gaps", "gaps").alias("gaps"),
        F.coalesce(given, F.col("impressao")).alias("impressao"),
        F.when(has, F.coalesce(F.col("n.lido_em"), F.lit(today).cast("date"))).otherwise(F.col("lido_em"))
        .alias("lido_em"))


# --------------------------------------------------------------------------- writers


def _read_or_none(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace only the partitions that the frame holds."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def backup_once(df: DataFrame, path: str, day: str) -> bool:
    """SNK-05: one copy per UTC day; the first write of the day wins."""
    stored = _read_or_none(df.sparkSession, path)
    if stored is not None and not stored.filter(F.col("dia") == F.lit(day).cast("date")).isEmpty():
        return False
    write_partitions(df.withColumn("dia", F.lit(day).cast("date")), path, "dia")
    return True


def write_run_report(report: DataFrame, path: str, day: str) -> None:
    """SNK-06: one JSON record per run day."""
    (report.withColumn("dia", F.lit(day)).coalesce(1).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("dia").json(path))


def write_judgements(judgements: DataFrame, path: str) -> None:
    """SNK-07: sorted by id over all files, so equal content gives equal files."""
    judgements.orderBy("id").write.mode("overwrite").parquet(path)


def snapshot_table(spark: SparkSession, path: str, schema: StructType, keys: list[str], parts: int = 16) -> PartTable:
    """SNK-09: the stored copy of an external snapshot."""
    return PartTable(spark, path, schema, keys, parts)


def replace_snapshot(table: PartTable, rows: DataFrame, consulted_at: str) -> bool:
    """SNK-09: a full external snapshot replaces the stored one, unless it is older.

    ``consulted_at``: an ISO instant.  Readers see the old rows until the new ones are all written.
    """
    at = dt.datetime.fromisoformat(str(consulted_at)).isoformat()
    if table.facts().get("consultado_em", at) > at:
        return False
    table.replace(rows, facts={"consultado_em": at})
    return True


def write_suggestions(boards: DataFrame, path: str) -> None:
    """SNK-10: company suggestions, most relevant first."""
    (boards.orderBy(F.desc("aprovada"), F.desc("design"), F.desc("total"), "provedor", "org")
     .write.mode("overwrite").json(path))


def append_events(events: DataFrame, path: str) -> None:
    """Append to a history table, partitioned by day of the event."""
    events.withColumn("dia", F.to_date("em")).write.mode("append").partitionBy("dia").parquet(path)


def cache_table(spark: SparkSession, path: str, schema: StructType, parts: int = 64) -> PartTable:
    """SNK-01: the posting cache, dealt into parts by id."""
    return PartTable(spark, path, schema, ["id_externo"], parts)


def save_cache(table: PartTable, new: DataFrame, now, sparse: tuple = (), batch: int | None = None) -> list[int]:
    """SNK-01: ``upsert_cache`` of the parts that hold ids of ``new``, a written table; returns these parts."""
    return table.merge(new.filter("id_externo IS NOT NULL"), lambda stored, rows: upsert_cache(stored, rows, now, sparse), batch)


def expunge_cache(table: PartTable, now, profile=DEFAULT_PROFILE, kw=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY) -> list[int]:
    """SNK-01: rows that fail today's filter leave the cache; parts without such rows are not written.

    The rules run once over each row: what passes is written whole, of what fails only the key, which names the parts to change.
    """
    columns = [f.name for f in table.schema]
    judged = {}

    def failing(rows: DataFrame) -> DataFrame:
        ruled = bind(filters.with_reason(rows, now, profile, kw, parity).select(*columns, "reason"), _passes=F.col("reason").isNull())
        judged["rows"] = cut_lineage(ruled.select(
            "_passes", *[F.col(c) if c in table.keys else F.when(F.col("_passes"), F.col(c)).alias(c) for c in columns]), "judged")
        return judged["rows"].filter("NOT _passes")

    def passing(stored: DataFrame) -> DataFrame:
        touched = table.with_part(judged["rows"].filter("NOT _passes")).select(PART).distinct()
        return table.with_part(judged["rows"].filter("_passes")).join(touched, PART, "left_semi").select(*columns)

    return table.rewrite(failing, passing)
