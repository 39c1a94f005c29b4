"""The given tables, and the postings, judgements and board derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2001-08-02 00:00:00"

# The same text runs in Spark and in the oracle.
POSTINGS_SQL = """
SELECT
  concat(CASE o.o_orderkey % 5 WHEN 0 THEN 'gupy' WHEN 1 THEN 'remotar' WHEN 2 THEN 'inhire' WHEN 3 THEN 'linkedin' ELSE 'arc' END, ':', CAST(o.o_orderkey AS VARCHAR(20))) AS id_externo,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'Gupy' WHEN 1 THEN 'Remotar' WHEN 2 THEN 'InHire' WHEN 3 THEN 'LinkedIn (Apify)' ELSE 'Arc' END AS fonte,
  concat(CASE o.o_orderkey % 7 WHEN 0 THEN 'Senior Product Designer' WHEN 1 THEN 'Product Designer - Remoto' WHEN 2 THEN 'Designer de Produto Pleno' WHEN 3 THEN 'Designer Gráfico' WHEN 4 THEN 'Software Engineer, Design Systems' WHEN 5 THEN 'UX/UI Designer Júnior' ELSE 'Analista Contábil' END,
         CASE WHEN o.o_orderkey % 11 = 0 THEN concat(' (', CAST(1000 + o.o_orderkey % 50 AS VARCHAR(20)), ')') ELSE '' END) AS titulo,
  c.c_name AS empresa,
  concat('https://www.', lower(replace(c.c_name, '#', '')), '.example.com/jobs/', CAST(o.o_orderkey % 4 AS VARCHAR(20)),
         CASE o.o_orderkey % 3 WHEN 0 THEN '/?utm_source=feed' WHEN 1 THEN '?gh_src=abc&p=1' ELSE '' END) AS link,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'remoto' WHEN 1 THEN 'hibrido' WHEN 2 THEN 'presencial' ELSE NULL END AS modelo,
  concat('Faixa: R$ ', CAST(1 + CAST(floor(o.o_totalprice / 20000) AS BIGINT) AS VARCHAR(20)), '.', lpad(CAST(o.o_orderkey % 1000 AS VARCHAR(20)), 3, '0'), ' por ', CASE o.o_orderkey % 3 WHEN 0 THEN 'mes' WHEN 1 THEN 'ano' ELSE 'hora' END) AS descricao,
  n.n_name AS pais,
  o.o_orderdate AS publicada_em,
  o.o_orderkey AS seq
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

# Board events: the posting an event is about is the order with the same key as its user.
STATUS_OF_EVENT = {
    "signup": "Avaliar", "view": "Avaliar", "click": "Aplicar", "purchase": "Já apliquei", "error": "Cancelada",
}


# The nations have no real names; three of them stand for places that accept the candidate.
PLACE_OF_NATION = {"NATION_0": "Brazil", "NATION_1": "Latin America", "NATION_2": "Americas"}


def place_of(nation: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in PLACE_OF_NATION.items() for x in kv])
    return F.coalesce(F.try_element_at(named, nation), nation)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the plans rely on: instants are UTC, adaptive execution splits hot keys."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table that is smaller than one split per core.

    A table that already has enough splits, as any large one has, is left as
    it is: no shuffle is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings derived from orders, customers and nations, one per order."""
    prepare(spark)
    return spark.sql(
        POSTINGS_SQL,
        orders=spread(table(spark, sf_dir, "orders")), customer=table(spark, sf_dir, "customer"),
        nation=table(spark, sf_dir, "nation"))


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One judgement per labelled document, keyed by the posting of the same number.

    The key is the id under which the posting's source knows it.
    """
    labels = table(spark, sf_dir, "labels")
    ids = postings(spark, sf_dir).select("id_externo", "seq", "descricao")
    return labels.join(ids, F.col("doc_id") == F.col("seq")).select(
        F.col("id_externo").alias("id"),
        (F.col("quality") * 30 + F.col("toxic") * 25).cast("double").alias("nota"),
        F.when(F.col("quality") == 1, "boa").alias("resumo"),
        F.when(F.col("toxic") == 1, "revisar").alias("gaps"),
        F.when(F.col("toxic") == 1, F.lit("000000000000"))
        .otherwise(F.substring(F.sha1("descricao"), 1, 12)).alias("impressao"),
        F.lit("2001-07-01").cast("date").alias("lido_em"))


def board_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status moves read from the event log: (id, em, para, seq)."""
    prepare(spark)
    mapping = F.create_map(*[F.lit(x) for kv in STATUS_OF_EVENT.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), F.col("ts").alias("em"),
        mapping[F.col("event_type")].alias("para"), F.col("event_id").alias("seq"))


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board after all events, one card per event subject.

    A third of the cards carry the posting's id, a third only its link and the
    rest only company and title, so every step of the lookup is used.
    """
    events = board_events(spark, sf_dir)
    current = events.groupBy("id").agg(
        F.max_by("para", F.struct("em", "seq")).alias("status"), F.max("em").alias("em"))
    ids = postings(spark, sf_dir).select("id_externo", "titulo", "empresa", "link", F.col("seq").cast("string").alias("_k"))
    n = F.col("_k").cast("bigint") % 3
    return current.join(ids, F.col("id") == F.col("_k")).select(
        F.when(n == 0, F.col("id_externo")).otherwise(F.concat(F.lit("manual:"), "_k")).alias("id"),
        "status", F.when(n != 1, F.col("titulo")).alias("titulo"), F.when(n != 1, F.col("empresa")).alias("empresa"),
        F.when(n == 1, F.col("link")).alias("url"), F.col("_k").cast("bigint").alias("ord"))
