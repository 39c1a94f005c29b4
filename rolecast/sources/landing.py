"""The landing zone of raw payloads, and what could not be read from it (SRC-14, SRC-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolecast.operators.versioned import PartTable

# ``source`` and the day of landing are the partition columns: a normalizer reads only its own payloads.
RAW_SCHEMA = "source string, entry string, fetched_at timestamp, url string, http_status int, body string"

# The columns every normalizer delivers, with their types.
POSTING_FIELDS = {
    "id_externo": "string", "fonte": "string", "camada": "string", "titulo": "string", "empresa": "string",
    "descricao": "string", "link": "string", "cidade": "string", "estado": "string", "pais": "string",
    "localizacao": "string", "restricao_pais": "string", "paises_aceitos": "array<string>", "modelo": "string",
    "remoto": "boolean", "publicada_em": "timestamp", "atualizada_em": "timestamp", "republicada_em": "timestamp",
    "prazo": "timestamp",
    "salario_bruto": "struct<de:double,ate:double,moeda:string,origem:string,periodo:string>",
    "status_fonte": "string", "encerrada": "boolean", "validada": "boolean", "descricao_pendente": "boolean",
    "elegibilidade_latam": "boolean", "elegibilidade_motivo": "string", "senioridade": "string", "ingles": "string",
    "contrato": "string", "paga_em_dolar": "boolean", "url_pagina": "string", "seq": "bigint",
}


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMA + ", day date").parquet(path)


def write_raw(df: DataFrame, path: str) -> None:
    df.withColumn("day", F.to_date("fetched_at")).write.mode("append").partitionBy("source", "day").parquet(path)


def payloads(raw: DataFrame, source: str, kind: str | None = None, since=None) -> DataFrame:
    """Usable payloads of one source; ``kind`` narrows by a pattern on the URL, ``since`` by the day of landing."""
    df = raw.filter((F.col("source") == source) & F.col("body").isNotNull() & F.coalesce(
        F.col("http_status") < 400, F.lit(True)))
    if since is not None:
        df = df.filter(F.col("fetched_at") >= F.lit(since).cast("timestamp"))
        if "day" in df.columns:  # prunes the landing zone's folders
            df = df.filter(F.col("day") >= F.to_date(F.lit(since).cast("timestamp")))
    return df.filter(F.col("url").rlike(kind)) if kind else df


def latest(pages: DataFrame, *keys: str) -> DataFrame:
    """The newest landing of each page; equal instants fall back on the content."""
    keys = keys or ("source", "entry", "url")
    row = F.struct(*[c for c in pages.columns if c not in keys])
    return pages.groupBy(*keys).agg(F.max_by(row, F.struct("fetched_at", F.xxhash64("body"))).alias("_r")).select(*keys, "_r.*")


class ReadMarks:
    """SRC-15: per source the instant up to which its landings have been read, kept at ``path``."""

    SCHEMA = StructType().add("fonte", "string").add("lido_ate", "long")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, PartTable(spark, path, self.SCHEMA, ["fonte"], parts=1)

    def known(self) -> dict[str, int]:
        """Microseconds by source; as many rows as there are sources."""
        return {r.fonte: r.lido_ate for r in self.table.read().collect()}

    def advance(self, newest: dict[str, int]) -> None:
        """A mark never goes back."""
        rows = self.spark.createDataFrame(list(newest.items()), self.SCHEMA)
        self.table.merge(rows, lambda stored, new: stored.unionByName(new).groupBy("fonte").agg(F.max("lido_ate").alias("lido_ate")))


def _after(mark: int | None, raw: DataFrame, overlap_days: int) -> Column:
    if mark is None:
        return F.lit(True)
    from_then = F.timestamp_micros(F.lit(mark)) - F.make_dt_interval(days=F.lit(overlap_days))
    after = F.col("fetched_at") > from_then
    return after & (F.col("day") >= F.to_date(from_then)) if "day" in raw.columns else after  # prunes the zone's folders


def news(raw: DataFrame, marks: dict[str, int], sources: tuple[str, ...]) -> dict[str, int]:
    """The newest landing of each source that has one after its mark.

    Reads instants only, from the mark's day on; a source without news is not read again.
    """
    some = raw.filter(F.col("source").isin(*sources) & F.col("fetched_at").isNotNull())
    wanted = F.lit(False)
    for source in sources:
        wanted = wanted | ((F.col("source") == source) & _after(marks.get(source), raw, 0))
    found = some.filter(wanted).groupBy("source").agg(F.max(F.unix_micros("fetched_at")).alias("newest")).collect()
    return {r["source"]: r.newest for r in found}


def unread(raw: DataFrame, source: str, mark: int | None, newest: int, overlap_days: int = 0) -> DataFrame:
    """One source's landings after its mark, up to the newest that ``news`` saw.

    A detail page that lands after its list page is found if both lie within ``overlap_days`` before the mark.
    """
    upto = F.col("fetched_at") <= F.timestamp_micros(F.lit(newest))
    return raw.filter((F.col("source") == source) & _after(mark, raw, overlap_days) & upto)


def config_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-14: a JSON configuration file as a table with a declared schema."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def failures(raw: DataFrame, json_sources: list[str]) -> DataFrame:
    """SRC-15: payloads that cannot be read; the run goes on without them."""
    why = (
        F.when(F.col("body").isNull(), "sem corpo")
        .when(F.col("http_status") >= 400, F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))
        .when(F.col("source").isin(*json_sources) & F.try_parse_json("body").isNull(), "JSON invalido"))
    return raw.select("source", "entry", "url", why.alias("motivo")).filter("motivo IS NOT NULL")
