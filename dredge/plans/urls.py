"""Queries of the URL functions and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.config import CrawlConfig
from dredge.functions import columns as C
from dredge.functions.web_url import normalize_url, resolve_url, url_to_string, valid_url
from dredge.operators import domains, scope
from dredge.plans.base import ENCODED_SQL, HOST_SQL, HREFS_SQL, ORIGIN_SQL, TARGETS_SQL, hrefs, table, targets

_HOST = HOST_SQL.format("url")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", C.scheme(u).alias("scheme"), C.authority(u).alias("authority"), C.hostname(u).alias("host"), C.path(u).alias("path"), C.query(u).alias("query"))


def host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(C.hostname(F.col("url")).alias("host")).agg(F.count("*").alias("n_pages"))


def strip_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(C.strip_fragment(F.col("url")).alias("plain_url")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n_pages"))


def url_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("target")
    return targets(spark, sf_dir).select(
        "page_id", "pos", F.octet_length(u).cast("long").alias("n_bytes"), C.too_long(u, 48).alias("too_long"), C.supported_scheme(u).alias("scheme_ok"), C.supported_host(u).alias("host_ok"),
        C.skipped_protocol(F.col("href")).alias("skipped"),
    )


def path_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's path, repeated as often as the page's number says."""
    p = C.path(F.col("url"))
    made = table(spark, sf_dir, "pages").select("page_id", F.expr("repeat(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), cast(page_id % 6 + 1 AS int))").alias("path"), C.query(F.col("url")).alias("query"), p.alias("own"))
    return made.select("page_id", C.path_loop(F.col("path"), F.col("query")).alias("looped"), C.path_loop(F.col("own"), F.expr("repeat(query || '&', cast(page_id % 5 + 1 AS int))")).alias("query_looped"))


_COUNTS = "list_transform(list_distinct({p}), lambda x: len(list_filter({p}, lambda y: y = x)))"


def _loop_sql(path: str, query: str) -> str:
    segments, pairs = f"list_filter(string_split({path}, '/'), lambda s: s <> '')", f"list_filter(string_split({query}, '&'), lambda s: s <> '')"
    counts, doubles = _COUNTS.format(p=segments), _COUNTS.format(p=pairs)
    return f"(len(list_filter({counts}, lambda n: n > 3)) > 0 OR len(list_filter({doubles}, lambda n: n > 3)) > 0 OR (len({segments}) >= 10 AND len(list_filter({counts}, lambda n: n >= 3)) >= 2))"


def file_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(spark, sf_dir).select("page_id", "pos", "target", C.has_file_extension(F.col("target")).alias("has_extension"))


def reversed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = C.hostname(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", C.reverse_host(F.concat(F.upper(host), F.lit("."))).alias("plain"), C.reverse_host(F.concat(host, F.lit(":8080"))).alias("with_port"))


def hops_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("page_id") % 7).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", C.encode_hops(n).alias("path"), C.decode_hops(F.concat(C.encode_hops(n), F.lit("RL"))).cast("long").alias("hops"))


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = CrawlConfig(include_hosts=("example.com", "example.net"), include_strings=("/fr/",), exclude_strings=("ref=x",), exclusions=("/en/[0-9]$", r"\.html$"))
    u = F.col("url")
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", scope.included(u, config).alias("included"), scope.excluded(u, config).alias("excluded"), scope.in_scope(u, config).alias("in_scope"))


_PATTERNS = ("example.org", "https://blog.ththan.example.net", "/fr/[0-9]+")


def domain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return domains.matched(pages, domains.classify(list(_PATTERNS))).select("page_id", "url", "matched")


def host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = C.hostname(F.col("url"))
    return table(spark, sf_dir, "pages").select(F.explode(C.host_suffixes(host)).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"))


def rewritten_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = targets(spark, sf_dir).select("page_id", "pos", F.col("target").alias("url"), (F.col("page_id") % 4).cast("int").alias("hops"))
    return domains.rewrite_hops(out, domains.classify(["example.org"]), 2).select("page_id", "pos", F.col("hops").cast("long").alias("hops"))


def short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.short_id(F.md5("url"), F.col("page_id") % 2 == 0).alias("short"))


def github_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, ("https://github.com/user-attachments/", "https://avatars.githubusercontent.com/u/", "https://github.com/a/b/assets/", "https://github.com/a/b/issues/", "https://example.com/assets/"))), (F.col("page_id") % 5 + 1).cast("int"))
    u = F.concat(tail, F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", u.alias("link"), C.github_asset(u).alias("asset"))


def unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.concat(F.col("url"), F.lit("?w=1&amp;s=%41"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", C.unescape_ampersands(u).alias("link"))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hrefs(spark, sf_dir).select("page_id", "pos", normalize_url(F.col("href"), F.col("url")).alias("n"))
    return rows.select("page_id", "pos", "n.url", "n.error")


def normalized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", normalize_url(F.concat(F.lit('"'), F.regexp_replace("url", "^https?://", ""), F.lit('"'))).alias("n"))
    return rows.select("page_id", "n.url", "n.error")


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", resolve_url(F.concat(F.lit("../x/"), F.col("page_id").cast("string"), F.lit("?q#f")), F.col("url")).alias("link"), valid_url(F.col("url")).alias("valid"), url_to_string(F.col("url")).alias("text"))



QUERIES = {
    "url_parts": (url_parts, r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority,
        lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':[0-9]*$', '')) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages"""),
    "host_counts": (host_counts, f"SELECT {_HOST} AS host, count(*) AS n_pages FROM pages GROUP BY 1"),
    "strip_fragments": (strip_fragments, "SELECT regexp_replace(url, '#.*$', '') AS plain_url, min(page_id) AS first_page, count(*) AS n_pages FROM pages GROUP BY 1"),
    "url_checks": (url_checks, f"""WITH {TARGETS_SQL} SELECT page_id, pos::BIGINT AS pos, strlen(target) AS n_bytes, strlen(target) > 48 AS too_long, regexp_matches(lower(target), '^https?:') AS scheme_ok,
        {HOST_SQL.format('target')} NOT IN ('localhost', '127.0.0.1') AND contains({HOST_SQL.format('target')}, '.') AS host_ok, regexp_matches(lower(href), '^(data|file|javascript|mailto|sms|tel):') AS skipped FROM targets"""),
    "path_loops": (path_loops, f"""WITH p AS (SELECT page_id, repeat(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), (page_id % 6 + 1)::INT) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS own FROM pages),
        q AS (SELECT *, repeat(query || '&', (page_id % 5 + 1)::INT) AS many FROM p) SELECT page_id, {_loop_sql('path', 'query')} AS looped, {_loop_sql('own', 'many')} AS query_looped FROM q"""),
    "file_extensions": (file_extensions, f"""WITH {TARGETS_SQL}, p AS (SELECT page_id, pos, target, regexp_replace(target, '[?#].*$', '', 's') AS plain FROM targets)
        SELECT page_id, pos::BIGINT AS pos, target, NOT ((starts_with(plain, '//') OR contains(plain, '://')) AND len(plain) - len(replace(plain, '/', '')) = 2) AND contains(string_split(plain, '/')[-1], '.') AND NOT ends_with(plain, '.') AS has_extension FROM p"""),
    "reversed_hosts": (reversed_hosts, f"""SELECT page_id, array_to_string(list_reverse(string_split({_HOST}, '.')), '.') AS plain, array_to_string(list_reverse(string_split({_HOST}, '.')), '.') || ':8080' AS with_port FROM pages"""),
    "hops_codec": (hops_codec, "SELECT page_id, repeat('L', (page_id % 7)::INT) AS path, page_id % 7 + 1 AS hops FROM pages"),
    "scope": (scoped, f"""WITH p AS (SELECT page_id, contains({_HOST}, 'example.com') OR contains({_HOST}, 'example.net') OR contains(url, '/fr/') AS included,
        contains({_HOST}, 'archive.org') OR contains({_HOST}, 'archive-it.org') OR contains(url, 'ref=x') OR regexp_matches(url, '/en/[0-9]$|\\.html$') AS excluded FROM pages) SELECT *, included AND NOT excluded AS in_scope FROM p"""),
    "domain_match": (domain_match, f"""SELECT page_id, url, {_HOST} = 'example.org' OR ends_with({_HOST}, '.example.org') OR url = 'https://blog.ththan.example.net' OR {_HOST} = 'blog.ththan.example.net' OR ends_with({_HOST}, '.blog.ththan.example.net') OR regexp_matches(url, '/fr/[0-9]+') AS matched FROM pages"""),
    "host_suffixes": (host_suffixes, f"""WITH p AS (SELECT string_split({_HOST}, '.') AS l FROM pages), s AS (SELECT array_to_string(l[i:], '.') AS suffix FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM p)) SELECT suffix, count(*) AS n FROM s GROUP BY 1"""),
    "rewritten_hops": (rewritten_hops, f"""WITH {TARGETS_SQL}, m AS (SELECT page_id, pos, page_id % 4 AS hops, {HOST_SQL.format('target')} AS h FROM targets) SELECT page_id, pos::BIGINT AS pos, CASE WHEN ends_with(h, '.example.org') OR h = 'example.org' THEN 0 ELSE hops END AS hops FROM m WHERE ends_with(h, '.example.org') OR h = 'example.org' OR hops <= 2"""),
    "short_ids": (short_ids, "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'seed-' ELSE 'asset-' END || substr(md5(url), 1, 5) AS short FROM pages"),
    "github_assets": (github_assets, """WITH p AS (SELECT page_id, ['https://github.com/user-attachments/', 'https://avatars.githubusercontent.com/u/', 'https://github.com/a/b/assets/', 'https://github.com/a/b/issues/', 'https://example.com/assets/'][page_id % 5 + 1] || page_id AS link FROM pages)
        SELECT page_id, link, page_id % 5 IN (0, 1, 2) AS asset FROM p"""),
    "unescaped_ampersands": (unescaped, "SELECT page_id, url || '?w=1&s=A' || page_id AS link FROM pages"),
    "normalized_links": (normalized, f"""WITH {HREFS_SQL} SELECT page_id, pos::BIGINT AS pos, {ORIGIN_SQL.format('url')} || {ENCODED_SQL.format('href')} AS url, CAST(NULL AS VARCHAR) AS error FROM hrefs"""),
    "normalized_pages": (normalized_pages, r"SELECT page_id, 'http://' || regexp_replace(regexp_replace(url, '^https?://', ''), '#.*$', '') AS url, CAST(NULL AS VARCHAR) AS error FROM pages"),
    "resolved_links": (resolved, rf"""WITH p AS (SELECT *, string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS l FROM pages)
        SELECT page_id, {ORIGIN_SQL.format('url')} || '/' || array_to_string(list_concat(l[2:-3], ['x', page_id || '?q#f']), '/') AS link, true AS valid, url AS text FROM p"""),
}
