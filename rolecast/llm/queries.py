"""One thin registered query per operator, over its whole table, and oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.llm import (
    adaptive_scan, backoff_lm, bag_minhash, chat_windows, decontaminate, html_main, licenses, line_index, mixing, quality, repeats,
    spelling, token_alignment,
)
from rolecast.operators.shaping import checkpoint_root

HELD_OUT = "crc32(CAST(doc_id AS STRING)) % 5 = 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    checkpoint_root(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: A conversation whose texts hold control strings of templates.
TRICKY = r"\### Assistant: </turn> ok"


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted windows of every conversation hold, read back from them."""
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_windows.read_back(chat_windows.windows(turns))


def op2_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels only from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    field = quality.train(docs, table(spark, sf_dir, "labels"), usable=~F.expr(HELD_OUT))
    return quality.score(docs, field, keep=["doc_id"]).select(
        "doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = html_main.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op4_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest neighbours of every vector whose id is divisible by 50."""
    return adaptive_scan.search(table(spark, sf_dir, "embeddings"), lambda key: F.pmod(key, F.lit(50)) == 0)


def op5_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with benchmark items that they contain."""
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.inline("leaks")).withColumnRenamed("item", "item_id")


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document by the counts of all others."""
    return backoff_lm.score_documents(table(spark, sf_dir, "documents"))


def op8_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base, more = F.col("scan.phrases"), F.col("scan.templates")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "scan.n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(base["first"]).alias("first_word"), F.array_max(base["first"]).alias("last_word"),
        joined(base["label"]).alias("base_labels"), joined(F.concat(base["label"], more["label"])).alias("labels"),
        F.when(F.size(more) > 0, 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0).alias("score"),
        F.size(more).cast("long").alias("n_templates"))


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document without strings of 100 bytes that stand earlier."""
    done = repeats.cut_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return done.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"))


def op10_mix_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizations of every document, with the links' counts over all documents."""
    return token_alignment.aligned_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op12_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in ten of them or more."""
    done = line_index.drop_common_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return done.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256"))


def op13_spelling_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commoner form of every word that is one letter away from it."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat_windows": op1_chat_windows,
    "op2_quality_lines": op2_quality_lines,
    "op3_site_templates": op3_site_templates,
    "op4_adaptive_scan": op4_adaptive_scan,
    "op5_latent_leaks": op5_latent_leaks,
    "op6_bag_minhash": op6_bag_minhash,
    "op7_stupid_backoff": op7_stupid_backoff,
    "op8_license_templates": op8_license_templates,
    "op9_suffix_repeats": op9_suffix_repeats,
    "op10_mix_thresholds": op10_mix_thresholds,
    "op11_token_alignment": op11_token_alignment,
    "op12_line_index": op12_line_index,
    "op13_spelling_pivots": op13_spelling_pivots,
}

ORACLES = {
    "op10_mix_thresholds": """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS BIGINT) AS w FROM s),
c AS (SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM r),
o AS (SELECT *,
        CAST(sum(w) OVER () AS BIGINT) - coalesce(CAST(sum(w) OVER b AS BIGINT), 0) AS rest_w,
        total - coalesce(CAST(sum(cap) OVER b AS BIGINT), 0) AS rest
      FROM c WINDOW b AS (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(rest AS DOUBLE) / CAST(rest_w AS DOUBLE) AS lev FROM o),
f AS (SELECT *, (SELECT x.lev FROM l x WHERE x.lev * x.w <= x.cap ORDER BY x.cap / x.w, encode(x.source) NULLS LAST LIMIT 1) AS level FROM l),
t AS (SELECT source, source_size, least(coalesce(level * w, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM f),
p AS (SELECT *, CAST(least(floor(target / greatest(source_size, 1)), 3) AS BIGINT) AS whole FROM t),
q AS (SELECT *, CAST(floor(target - whole * source_size) AS BIGINT) AS rem FROM p),
g AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source, h),
k AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM g)
SELECT d.doc_id, d.size, q.source_size, q.target,
  CAST(q.whole * d.size + CASE WHEN k.before + k.n <= q.rem THEN d.size WHEN k.before > q.rem THEN 0
       WHEN k.n = 0 THEN 0 ELSE floor(d.size * (q.rem - k.before) / k.n) END AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.h = d.h
""",
    "op12_line_index": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM d),
k AS (SELECT *, translate(trim(line, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
c AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, c.k IS NOT NULL AS gone FROM k LEFT JOIN c ON k.k = c.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
""",
}
