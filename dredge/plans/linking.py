"""Queries of the link extractors. Bodies of other formats are made of the pages' addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.functions import columns as C
from dredge.functions.css_links import css_links
from dredge.functions.html_links import decode_body, html_links
from dredge.functions.json_links import json_links
from dredge.functions.pdf_links import pdf_links
from dredge.functions.xml_links import listing_links, xml_links
from dredge.operators import extract, fetch, sites
from dredge.plans.base import ENCODED_SQL, HOST_SQL, HREFS_SQL, ORIGIN_SQL, TARGETS_SQL, table, targets


def outlink_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host of the linking page: pages, links, distinct targets. Pure Catalyst: one scan, one expansion, two shuffles."""
    found = targets(spark, sf_dir).select("page_id", C.strip_fragment(F.col("target")).alias("target"), C.hostname(F.col("url")).alias("host"))
    once = found.groupBy("host", "page_id", "target").agg(F.count("*").alias("n"))
    return once.groupBy("host").agg(F.countDistinct("page_id").alias("n_pages"), F.sum("n").alias("n_links"), F.countDistinct("target").alias("n_targets"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(spark, sf_dir).select("page_id", "pos", "href", "target")


def capped_outlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = targets(spark, sf_dir).select(F.col("url").alias("page_url"), "page_id", "pos", "target")
    return fetch.cap_outlinks(links, 3, ("page_id", "page_url")).select("page_id", "pos", "target")


def parsed_outlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlinks of each page by the parser."""
    pages = table(spark, sf_dir, "pages").select("page_id", html_links(F.col("html"), F.col("url")).alias("l"))
    return pages.select("page_id", F.size(F.filter("l", lambda x: x["kind"] == "outlink")).cast("long").alias("n_outlinks"), F.size(F.filter("l", lambda x: x["kind"] == "asset")).cast("long").alias("n_assets"))


def text_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see ("), F.col("url"), F.lit(") or <"), F.col("url"), F.lit("x>, and HTTP://Other.example/a?b=c, http://nodot/ end"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(C.text_links(text)).alias("pos", "link"))


def quoted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(C.quoted_links(F.concat(F.lit("a = '"), F.col("url"), F.lit("'; b = \"http://q.example/\"")))).alias("link"))


def link_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("<"), F.col("url"), F.lit('>; rel="next", <http://two.example/>; rel=prev, ;'))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(C.link_header(value)).alias("pos", "link"))


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,URI="alt/a.m3u8"\n#EXTINF:4,\n'), F.col("url"), F.lit("\nseg2.ts\n\n"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(C.playlist_links(body)).alias("pos", "link"))


def style_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    css = F.concat(F.lit('@import "base.css"; @import url(more.css); a{background:url("'), F.col("url"), F.lit('")} b{background:url( img\\2e png )}'))
    rows = table(spark, sf_dir, "pages").select("page_id", css_links(css).alias("c"))
    return rows.select("page_id", F.array_join("c.links", " ").alias("links"), F.array_join("c.imports", " ").alias("imports"))


def json_body_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.struct(F.col("url").alias("u"), F.lit("plain words").alias("t")).alias("a"), F.array(F.lit("https://cdn.example/x.js"), F.to_json(F.struct(F.lit("https://in.example/y").alias("v")))).alias("b")))
    rows = table(spark, sf_dir, "pages").select("page_id", json_links(body).alias("j"))
    return rows.select("page_id", F.array_join(F.array_sort("j.assets"), " ").alias("assets"), F.array_join(F.array_sort("j.outlinks"), " ").alias("outlinks"))



def sitemap_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url></urlset>"))
    rows = table(spark, sf_dir, "pages").select("page_id", xml_links(body).alias("x"))
    return rows.select("page_id", F.explode(F.concat("x.assets", "x.outlinks")).alias("link"))


def bucket_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    body = F.concat(F.lit("<ListBucketResult><Contents><Key>a/"), key, F.lit(".txt</Key><Size>5</Size></Contents><Contents><Key>z/"), key, F.lit("</Key><Size>0</Size></Contents></ListBucketResult>"))
    at = F.concat(F.lit("https://s3.example/?x="), key)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(listing_links(at, F.lit("AmazonS3"), body)).alias("pos", "link"))


def container_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    body = F.concat(F.lit("<EnumerationResults><Blobs><Blob><Name>/f"), key, F.lit("</Name></Blob></Blobs><NextMarker>m1</NextMarker></EnumerationResults>"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(listing_links(F.lit("https://acct.example/c?comp=list"), F.lit("Windows-Azure-Blob/1.0"), body)).alias("pos", "link"))


def pdf_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj<</A<</S/URI/URI ("), F.col("url"), F.lit(")>>>>endobj")).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", F.explode(pdf_links(body)).alias("link"))


def charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "text/html; charset=ISO-8859-1").when(F.col("page_id") % 3 == 1, "text/html; charset=utf-8")
    rows = table(spark, sf_dir, "pages").select("page_id", "html", decode_body(F.col("html").cast("binary"), kind).alias("d"))
    return rows.select("page_id", "d.charset", (F.col("d.text") == F.col("html")).alias("same"))


def site_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = F.array(*map(F.lit, ("https://www.npr.org/", "https://old.reddit.com/r/", "https://tiktok.com/@", "https://truthsocial.com/api/v1/statuses/", "https://truthsocial.com/@someone/posts/", "https://truthsocial.com/api/v1/accounts/")))
    u = F.concat(F.element_at(hosts, (F.col("page_id") % 6 + 1).cast("int")), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", sites.profile(u).alias("profile"), sites.post_status(u).alias("status_url"), F.size(sites.request_headers(u)).cast("long").alias("n_headers"))


def api_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    account = sites.account_statuses(F.concat(F.lit('{"id":"'), key, F.lit('"}')))
    post = sites.post_permalinks(F.concat(F.lit('{"data":{"children":[{"data":{"permalink":"/r/'), key, F.lit('"}}]}}')))
    video = sites.status_videos(F.concat(F.lit('{"media_attachments":[{"external_video_id":"v'), key, F.lit('"},{"external_video_id":""}]}')))
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(account, 2).alias("pinned"), F.element_at(post, 2).alias("old"), F.array_join(video, " ").alias("videos"))


def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    mimes = F.array(*map(F.lit, ("text/html", "application/json", "text/xml", "text/css", "application/pdf", "image/svg+xml", "application/vnd.apple.mpegurl")))
    mime = F.element_at(mimes, (F.col("page_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", extract.asset_extractor(F.col("url"), mime, F.lit("")).alias("assets"), extract.outlink_extractor(F.col("url"), mime, F.lit(None).cast("string"), F.lit("")).alias("outlinks"))


def all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page through the dispatcher."""
    rows = table(spark, sf_dir, "pages").select("url", F.lit("text/html").alias("mime"), F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"), F.col("html").alias("text"), F.lit(0).alias("hops"))
    return extract.links(rows)


_HOST = HOST_SQL.format("url")
_PAGE = "SELECT page_id, unnest({0}) AS link FROM pages"
QUERIES = {
    "outlink_hosts": (outlink_hosts, f"""WITH {TARGETS_SQL}, f AS (SELECT page_id, {_HOST} AS host, regexp_replace(target, '#.*$', '') AS target FROM targets) SELECT host, count(DISTINCT page_id) AS n_pages, count(*) AS n_links, count(DISTINCT target) AS n_targets FROM f GROUP BY 1"""),
    "anchors": (anchors, f"WITH {TARGETS_SQL} SELECT page_id, pos::BIGINT AS pos, href, target FROM targets"),
    "capped_outlinks": (capped_outlinks, f"WITH {TARGETS_SQL} SELECT page_id, pos::BIGINT AS pos, target FROM targets WHERE pos < 3"),
    "parsed_outlinks": (parsed_outlinks, r"""SELECT page_id, len(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS n_outlinks, 0::BIGINT AS n_assets FROM pages"""),
    "text_links": (text_links, """WITH p AS (SELECT page_id, list_distinct([regexp_extract(url, '^([^,]*)', 1) || ')', url || 'x', 'HTTP://Other.example/a?b=c']) AS l, [url || ')', url || 'x', 'HTTP://Other.example/a?b=c'] AS o FROM pages) SELECT page_id, (i - 1)::BIGINT AS pos, o[i] AS link FROM (SELECT page_id, o, unnest(range(1, 4)) AS i FROM p)"""),
    "quoted_links": (quoted_links, _PAGE.format("[url, 'http://q.example/']")),
    "link_headers": (link_headers, "SELECT page_id, (i - 1)::BIGINT AS pos, [url, 'http://two.example/'][i] AS link FROM (SELECT page_id, url, unnest([1, 2]) AS i FROM pages)"),
    "playlists": (playlists, "SELECT page_id, (i - 1)::BIGINT AS pos, [url, 'seg2.ts', 'alt/a.m3u8'][i] AS link FROM (SELECT page_id, url, unnest([1, 2, 3]) AS i FROM pages)"),
    "style_links": (style_links, "SELECT page_id, url || ' img.png' AS links, 'base.css more.css' AS imports FROM pages"),
    "json_body_links": (json_body_links, r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS plain FROM pages), q AS (SELECT *, contains(string_split(plain, '/')[-1], '.') AND len(plain) - len(replace(plain, '/', '')) > 2 AND NOT ends_with(plain, '.') AS ext FROM p)
        SELECT page_id, array_to_string(list_sort(CASE WHEN ext THEN [url, 'https://cdn.example/x.js'] ELSE ['https://cdn.example/x.js'] END), ' ') AS assets, array_to_string(list_sort(CASE WHEN ext THEN ['https://in.example/y'] ELSE [url, 'https://in.example/y'] END), ' ') AS outlinks FROM q"""),
    "sitemap_links": (sitemap_links, _PAGE.format("[url, 'http://www.sitemaps.org/schemas/sitemap/0.9']")),
    "bucket_listings": (bucket_listings, "SELECT page_id, (i - 1)::BIGINT AS pos, ['https://s3.example/?marker=z%2F' || page_id || '&x=' || page_id, 'https://s3.example/a/' || page_id || '.txt'][i] AS link FROM (SELECT page_id, unnest([1, 2]) AS i FROM pages)"),
    "container_listings": (container_listings, "SELECT page_id, (i - 1)::BIGINT AS pos, ['https://acct.example/c?comp=list&marker=m1', 'https://acct.example/c/f' || page_id][i] AS link FROM (SELECT page_id, unnest([1, 2]) AS i FROM pages)"),
    "pdf_annotations": (pdf_annotations, "SELECT page_id, url AS link FROM pages"),
    "charsets": (charsets, """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'windows-1252' ELSE 'utf-8' END AS charset, page_id % 3 > 0 OR strlen(html) = length(html) AS same FROM pages"""),
    "site_profiles": (site_profiles, """SELECT page_id, ['npr', 'reddit', 'tiktok', 'status', NULL, 'account'][page_id % 6 + 1] AS profile, CASE page_id % 6 WHEN 4 THEN 'https://truthsocial.com/api/v1/statuses/' || page_id END AS status_url, [13, 1, 13, 10, 0, 9][page_id % 6 + 1]::BIGINT AS n_headers FROM pages"""),
    "api_links": (api_links, "SELECT page_id, 'https://truthsocial.com/api/v1/accounts/' || page_id || '/statuses?pinned=true&only_replies=false&with_muted=true' AS pinned, 'https://old.reddit.com/r/' || page_id AS old, 'https://truthsocial.com/api/v1/truth/videos/v' || page_id AS videos FROM pages"),
    "dispatch": (dispatch, "SELECT page_id, ['html', 'json', 'xml', 'css', NULL, NULL, 'm3u8'][page_id % 7 + 1] AS assets, ['html', NULL, NULL, NULL, 'pdf', NULL, NULL][page_id % 7 + 1] AS outlinks FROM pages"),
    "all_links": (all_links, f"""WITH {HREFS_SQL}, t AS (SELECT *, {ORIGIN_SQL.format('url')} || {ENCODED_SQL.format('href')} AS target FROM hrefs)
        SELECT url AS page_url, target AS url, 'outlink' AS kind, 'a' AS tag, pos::INT AS pos, 1::INT AS hops FROM t WHERE target <> url"""),
}
