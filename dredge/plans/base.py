"""Inputs that several queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Anchors of a page; every page of the tables writes them this way.
ANCHOR = r'<a\s[^>]*?href="([^"]*)"'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, pos, href) of every anchor."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("pos", "href"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hrefs plus target: the root-relative link resolved against its page."""
    origin = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    return hrefs(spark, sf_dir).withColumn("target", F.when(F.col("href").startswith("/"), F.concat(origin, "href")).otherwise(F.col("href")))


HREFS_SQL = r"""hrefs AS (SELECT page_id, url, pos - 1 AS pos, list[pos] AS href FROM (
  SELECT page_id, url, list, unnest(range(1, len(list) + 1)) AS pos FROM (
    SELECT page_id, url, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS list FROM pages)))"""
TARGETS_SQL = HREFS_SQL + r""", targets AS (SELECT *, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href ELSE href END AS target FROM hrefs)"""
#: A root-relative address as it is written: what isn't ASCII, and the characters that a path can't have, in percent form.
ENCODED_SQL = r"""array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN c <> '' AND (unicode(c) > 127 OR c IN (' ', '"', '<', '>', '^', '`', '{{', '|', '}}')) THEN url_encode(c) ELSE c END), '')"""
ORIGIN_SQL = r"regexp_extract({0}, '^([a-z]+://[^/?#]+)', 1)"
HOST_SQL = r"lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
