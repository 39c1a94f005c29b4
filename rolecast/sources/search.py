"""Links in landed HTML: search results, anchors and URL lists (SRC-04, SRC-09, SRC-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.functions import html


def search_result_links(page: Column) -> Column:
    """SRC-09: distinct target URLs of a result page; ads, scripts and styles dropped."""
    wrapped = F.transform(F.regexp_extract_all(page, F.lit('uddg=([^"&]+)'), F.lit(1)), lambda u: F.try_url_decode(u))
    direct = F.filter(
        F.regexp_extract_all(page, F.lit('href="(https?://[^"]+)"'), F.lit(1)),
        lambda u: ~u.rlike(r"duckduckgo|ad_provider|\.js|\.css"))
    return F.array_distinct(F.array_compact(F.concat(wrapped, direct)))


def anchors(df: DataFrame, page: str, *keep: str) -> DataFrame:
    """SRC-04: (…, pos, href, texto) for every anchor of a page."""
    block = r"""(?is)(<a\b[^>]*href\s*=\s*["'][^"']+["'][^>]*>.*?</a>)"""
    blocks = df.select(*keep, F.posexplode(F.regexp_extract_all(F.col(page), F.lit(block), F.lit(1))).alias("pos", "_b"))
    href = F.regexp_extract("_b", r"""(?is)<a\b[^>]*href\s*=\s*["']([^"']+)["']""", 1)
    return blocks.select(
        *keep, "pos", F.replace(href, F.lit("&amp;"), F.lit("&")).alias("href"),
        html.clean_html(F.regexp_extract("_b", r"(?is)>(.*)</a>$", 1)).alias("texto"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: one URL per line; blank lines and comments are skipped."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("url")).filter((line != "") & ~line.startswith("#"))
