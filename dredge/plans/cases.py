"""Queries whose inputs are written out: every page takes the case that its number says.

The expected answers stand in the SQL twins, case by case, so a rule and its answer are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.config import CrawlConfig
from dredge.functions import columns as C
from dredge.functions.html_links import html_links
from dredge.functions.json_links import json_links
from dredge.functions.web_url import normalize_url, reencoded_query, resolve_url, url_list, url_to_string, valid_url
from dredge.functions.xml_links import sitemap_mark
from dredge.operators import extract, fetch, frontier, metrics, scope, seen, sites, tree
from dredge.plans.base import table
from dredge.sources import lists

_PAGE = "http://s.test/d/p"


def _pick(values: list, kind: str = "string") -> Column:
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), (F.col("page_id") % len(values) + 1).cast("int"))


def _sql(values: list, kind: str = "VARCHAR") -> str:
    said = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"([{', '.join(map(said, values))}]::{kind}[])[page_id % {len(values)} + 1]"


#: raw link, its page, what it becomes, or what is wrong with it.
_NORMAL = [
    ("https://site.test/path", None, "https://site.test/path", None),
    ("/path", "https://site.test", "https://site.test/path", None),
    ("www.site.test", None, "http://www.site.test/", None),
    ("www.site.test/cats", None, "http://www.site.test/cats", None),
    ("ftp://ftp.site.test", None, None, "unsupported_scheme"),
    ('"https://site.test/path"', None, "https://site.test/path", None),
    ("'/path'", "https://site.test", "https://site.test/path", None),
    ("/path", None, None, "unsupported_host"),
    ("http://localhost/x", None, None, "unsupported_host"),
    ("https://site.test/fonts/fonts/fonts/fonts/file.woff2", None, None, "path_loop"),
    ("https://lms.site.test/theme/styles.php/all/Tables/images/Tables/fonts/Tables/fonts/Tables/images/sort.png", None, None, "path_loop"),
    ("https://site.test/a/b/a/file.css", None, "https://site.test/a/b/a/file.css", None),
    ("https://site.test/" + "a" * 3983, None, None, "url_too_long"),
    ("https://site.test/" + "a" * 3982, None, "https://site.test/" + "a" * 3982, None),
    ("HTTP://SITE.test:80/a/./b/../c#part", None, "http://site.test/a/c", None),
    ("page?q=1", "https://site.test/a/b?c", "https://site.test/a/page?q=1", None),
]


def url_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normalize_url(_pick([c[0] for c in _NORMAL]), _pick([c[1] for c in _NORMAL]))
    return table(spark, sf_dir, "pages").select("page_id", n.alias("n")).select("page_id", "n.url", "n.error")


#: link, page, base; and the absolute form.
_RESOLVED = [
    ("x.html", None, "http://s.test/d/x.html"), ("../x", None, "http://s.test/x"), ("/x?y#z", None, "http://s.test/x?y#z"), ("//other.test/x", None, "http://other.test/x"),
    ("?q", None, "http://s.test/d/p?q"), ("https://else.test/", None, "https://else.test/"), ("x", "http://base.test/dir/", "http://base.test/dir/x"), ("ü", None, "http://s.test/d/%C3%BC"), ("a:b", None, "a:b"),
]
_TEXTS = [
    ("http://bücher.test:8080/x?b=ä&a=1&b=2", "http://xn--bcher-kva.test:8080/x?b=%C3%A4&b=2&a=1"), ("https://preview.redd.it/x.png?s=a%2Fb", "https://preview.redd.it/x.png?s=a%2Fb"),
    ("http://s.test/a b", "http://s.test/a%20b"),
]
_VALID = [("http://s.test", True), ("s.test/path", True), ("word", False), ("s.test", False), ("", False)]
_CODED = [("http://s.test/?q=%E4%BD%A0", "gbk", "http://s.test/?q=%C4%E3"), ("http://s.test/?b=%C3%A9&a=1", "iso-8859-1", "http://s.test/?a=1&b=%E9"), ("http://s.test/?q=%E4%BD%A0", "utf-8", "http://s.test/?q=%E4%BD%A0"), ("http://s.test/x", "gbk", "http://s.test/x")]


def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution against page and base, the string form, loose validity, and queries in a page's charset."""
    return table(spark, sf_dir, "pages").select(
        "page_id", resolve_url(_pick([c[0] for c in _RESOLVED]), F.lit(_PAGE), _pick([c[1] for c in _RESOLVED])).alias("resolved"), url_to_string(_pick([c[0] for c in _TEXTS])).alias("text"),
        valid_url(_pick([c[0] for c in _VALID])).alias("valid"), reencoded_query(_pick([c[0] for c in _CODED]), _pick([c[1] for c in _CODED])).alias("coded"),
    )


def url_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain forms, subdomains and lists of raw links."""
    hosts, domains = ["s.test", "a.s.test", "as.test", "a.b.s.test"], ["S.test.", "s.test", "s.test", "b.s.test"]
    return table(spark, sf_dir, "pages").select(
        "page_id", C.normalize_domain(_pick(domains)).alias("domain"), C.is_subdomain(_pick(hosts), C.normalize_domain(_pick(domains))).alias("below"),
        F.array_join(url_list(F.array(F.lit("http://s.test/a"), F.lit("http://[bad"), _pick(hosts))), " ").alias("urls"),
    )


#: markup and the assets, outlinks and imports of it, in order.
_MARKUP = [
    ('<video src="http://f1.test/a"></video><p>x</p><audio src="http://f2.test/b"></audio><embed type="video/mp4" src="/videos/f.mp4">', "http://f1.test/a http://f2.test/b http://s.test/videos/f.mp4", "", ""),
    ("""<div style="background: url('http://t.test/data.jpg')"></div><div data-preview="http://archive.test">x</div><div data-item='{"id": 1, "image": "https://t.test/image.jpg"}'>x</div>""", "http://t.test/data.jpg http://archive.test https://t.test/image.jpg", "", ""),
    ('<link rel="stylesheet" href="http://t.test/s.css"><link rel="alternate" href="http://t.test/alt"><link foo="1"><meta href="https://a1.test"><meta content="something"><meta http-equiv="Refresh" content="0; url=https://r1.test">', "http://t.test/s.css https://a1.test https://r1.test", "", ""),
    ("""<meta content="0; url=HTTP://UPPER.TEST/PAGE.HTML"><meta content="https://r2.test"><meta content="5"><meta content="0; url='https://q.test/1'"><meta content='0; url=  "https://q.test/2" '>""", "HTTP://UPPER.TEST/PAGE.HTML https://r2.test https://q.test/1 https://q.test/2", "", ""),
    ('<img srcset="http://t.test/a.jpg 480w, http://t.test/b.jpg 800w" src="http://t.test/c.jpg"><picture><source srcset="https://t.test/5.jpg?w=460 460w, http://t.test/6.jpg 340w"></picture>', "http://t.test/c.jpg http://t.test/a.jpg http://t.test/b.jpg https://t.test/5.jpg?w=460 http://t.test/6.jpg", "", ""),
    ('<HTML><BODY><A HREF="https://a.test/a.html">t</A><a onclick="window.location.href=\'two\'">t</a><iframe src="/three"></iframe><area href="four"></BODY></HTML>', "", "https://a.test/a.html http://s.test/d/two http://s.test/three http://s.test/d/four", ""),
    ("""<style>#h{background:transparent url(http://g.test/logo.jpg);} #f{background-image:url(//m.test/bg);}</style><div style="background: url(http://n.test/bg.png);">""", "http://g.test/logo.jpg http://m.test/bg http://n.test/bg.png", "", ""),
    ("<style>@import 'http://foo.test/common.css'; a{b:url(c.png)}</style>", "http://s.test/d/c.png", "", "http://foo.test/common.css"),
    ('<div data-src="https://t.test/audio.mp3"></div><div data-srcset="e.png 1x, f.png 2x"></div>', "https://t.test/audio.mp3 http://s.test/d/e.png http://s.test/d/f.png", "", ""),
    ('<a href="/static/n.css" data-src="/images/x.png">t</a><a href="/plain">t</a><replay-web-page source="/r.wacz"></replay-web-page>', "http://s.test/static/n.css http://s.test/images/x.png http://s.test/r.wacz", "http://s.test/static/n.css http://s.test/plain", ""),
    ('<script src="q.js" data-u="https://t.test/attr"></script><script>go("https://t.test/1", "https://t.test/1", "https://t.test/\\u0026x", "https://t.test/a\\/b")</script>', "http://s.test/d/q.js https://t.test/attr https://t.test/1 https://t.test/&x", "", ""),
    ('<script type="application/json">{"a": "https://t.test/j.js"}</script><script>var v = {"b": "https://t.test/v.png"};</script>', "https://t.test/j.js https://t.test/j.js https://t.test/v.png https://t.test/v.png", "", ""),
    ('<base href="http://b.test/x/"><a href="y">t</a><img src="../z.png">', "http://b.test/z.png", "http://b.test/x/y", ""),
    ('<base href="javascript:x"><a href="y">t</a><img data-src="l.png" data-lazy-src="m.png">', "http://s.test/d/l.png http://s.test/d/m.png", "http://s.test/d/y", ""),
    ("", "", "", ""),
]


def _of(links: Column, kind: str) -> Column:
    return F.array_join(F.transform(F.filter(links, lambda x: x["kind"] == kind), lambda x: x["url"]), " ")


def markup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", html_links(_pick([c[0] for c in _MARKUP]), F.lit(_PAGE)).alias("l"))
    return rows.select("page_id", *(_of(F.col("l"), k).alias(f"{k}s") for k in ("asset", "outlink", "import")))


_OFF = '<a href="one">t</a><a href="/static/two">t</a><iframe src="three"></iframe><img src="four"><link rel="alternate" href="five"><script src="six"></script>'


def disabled_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disabled tags give neither outlinks nor assets; alternates count where asked for; strict scripts; a page's charset."""
    pages, markup = table(spark, sf_dir, "pages"), F.concat(F.lit(_OFF), F.lit('<a href="/?q=é">'), F.col("page_id").cast("string"))
    some = pages.select("page_id", html_links(markup, F.lit(_PAGE), ("a", "script")).alias("off"), html_links(markup, F.lit(_PAGE), ("iframe", "img"), True, False, F.lit("iso-8859-1")).alias("on"))
    return some.select("page_id", _of(F.col("off"), "asset").alias("off_assets"), _of(F.col("off"), "outlink").alias("off_outlinks"), _of(F.col("on"), "asset").alias("on_assets"), _of(F.col("on"), "outlink").alias("on_outlinks"))


_RUNNING = [
    ("see (http://s.test/a) or <http://s.test/b>, http://s.test/c.", "http://s.test/a) http://s.test/b http://s.test/c.", "http://s.test/a http://s.test/b http://s.test/c"),
    ("http://s.test/wiki_(x) and HTTPS://S.test/a?b=c&d=[e]!", "http://s.test/wiki_(x) HTTPS://S.test/a?b=c&d=[e]!", "http://s.test/wiki_(x) HTTPS://S.test/a?b=c&d=[e]"),
    ("nothing here, ftp://s.test/a", "", ""),
    ("http://s.test/a http://s.test/a", "http://s.test/a", "http://s.test/a"),
]


def running_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in running text by the loose and the strict pattern."""
    text = _pick([c[0] for c in _RUNNING])
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(C.text_links(text), " ").alias("loose"), F.array_join(C.text_links(text, True), " ").alias("strict"))


_BODIES = [
    ("see http://s.test/a, http://s.test/b and\nhttp://s.test/a ", "http://s.test/a http://s.test/b"), ("x://a.b ftp://s.test/long http://a.b", "http://a.b"), ("http://s.test/1 " + "x" * 70_000 + " http://s.test/2", "http://s.test/1"), ("", ""),
]


def body_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of bodies word by word, up to a word that is too long."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(C.body_links(_pick([c[0] for c in _BODIES])), " ").alias("links"))


_SITES = [
    ("https://www.npr.org/1", "npr", 13, None, None), ("https://npr.org", None, 0, None, None), ("https://old.reddit.com/r/1", "reddit", 1, None, None), ("https://www.tiktok.com/@x", "tiktok", 13, None, None),
    ("https://truthsocial.com/api/v1/statuses/12?x=1", "status", 10, None, None), ("https://truthsocial.com/api/v1/statuses/12", "status", 10, "status", None), ("https://truthsocial.com/api/v1/truth/videos/ab1", "status", 10, None, None),
    ("https://truthsocial.com/api/v1/accounts/lookup?acct=ab", "status", 10, None, "lookup"), ("https://truthsocial.com/api/v1/accounts/12/statuses", "account", 9, None, None),
    ("https://truthsocial.com/@x/posts/1", None, 0, "post_page", "account"), ("https://truthsocial.com/@x", None, 0, None, "account"), ("https://apipartner.ina.fr/assets/1", None, 0, "media", None),
    ("https://www.reddit.com/api/info.json?id=t3_1", "reddit", 1, None, "post"), ("https://example.com/", None, 0, None, None),
]


def site_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request profile, its headers, and the extractors that a site's own addresses take (of a body without a type)."""
    u, none, empty = _pick([c[0] for c in _SITES]), F.lit(None).cast("string"), F.lit("")
    accept = F.element_at(sites.request_headers(u), "Accept")
    return table(spark, sf_dir, "pages").select(
        "page_id", sites.profile(u).alias("profile"), F.size(sites.request_headers(u)).cast("long").alias("n_headers"), (F.coalesce(accept, empty).startswith("application/json")).alias("asks_json"),
        extract.asset_extractor(u, F.lit("application/octet-stream"), empty).alias("assets"), extract.outlink_extractor(u, F.lit("application/octet-stream"), none, empty).alias("outlinks"),
    )


_STORES = [("AmazonS3", "store"), ("WasabiS3", "store"), ("UploadServer", "store"), ("AliyunOSS", "store"), ("Windows-Azure-Blob/1.0", "store"), ("nginx", None), (None, None)]
_SITEMAPS = [("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'/>", True), ("<!-- sitemaps.org/schemas/sitemap/ -->", True), ("<a b='sitemaps.org&#x2F;schemas/sitemap/'/>", True), ("<a/>", False)]


def xml_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object stores by their server, sitemaps by their mark in any token, and style sheets that are embedded or not."""
    server, body, css = _pick([c[0] for c in _STORES]), _pick([c[0] for c in _SITEMAPS]), F.col("page_id") % 3 == 0
    return table(spark, sf_dir, "pages").select(
        "page_id", extract.outlink_extractor(F.lit("http://s.test/x"), F.lit("application/xml"), server, F.lit("<a/>")).alias("store"), sitemap_mark(body).alias("sitemap"),
        extract.asset_extractor(F.lit("http://s.test/x"), F.lit("text/css"), F.lit(""), css).alias("css"),
    )


def mixed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per link of four kinds of answers: a sitemap served as a page, a status, a media description, an account."""
    k = F.col("page_id").cast("string")
    urls = ["http://s.test/map", "https://truthsocial.com/api/v1/statuses/1", "https://apipartner.ina.fr/assets/1", "https://truthsocial.com/@x"]
    mimes = ["text/html", "application/json", "application/json", "application/json"]
    bodies = [
        '<a href="http://s.test/never"><img src="http://s.test/i.png"><x y="http://www.sitemaps.org/schemas/sitemap/0.9"/>', '{"media_attachments":[{"external_video_id":"v1"}],"u":"http://s.test/s.js","o":"http://s.test/o"}',
        '{"resourceUrl":"http://s.test/r.mp4","resourceThumbnail":"http://s.test/t.jpg","embedUrl":"/e","uri":"http://s.test/u"}', '{"id":"7"}',
    ]
    none = F.create_map().cast("map<string,string>")
    rows = table(spark, sf_dir, "pages").select(F.concat(_pick(urls), F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("?"), k)).otherwise(F.lit(""))).alias("url"), _pick(mimes).alias("mime"), none.alias("headers"), _pick(bodies).alias("text"), F.lit(0).alias("hops"))
    return extract.links(rows.dropDuplicates(["url"])).select("page_url", "url", "kind", F.col("hops").cast("long").alias("hops"))


_ROOT = "https://truthsocial.com/api/v1/accounts/7/statuses?"
_MIXED_SQL = f"""WITH m AS (SELECT DISTINCT 'http://s.test/map?' || page_id AS page_url FROM pages WHERE page_id % 4 = 0), k AS (SELECT DISTINCT page_id % 4 AS k FROM pages)
  SELECT page_url, 'http://s.test/i.png' AS url, 'asset' AS kind, 0::BIGINT AS hops FROM m
  UNION ALL SELECT page_url, unnest(['http://s.test/never', 'http://www.sitemaps.org/schemas/sitemap/0.9', 'http://s.test/i.png']), 'outlink', 1 FROM m, range(2) -- by the sitemap and as text
  UNION ALL SELECT 'https://truthsocial.com/api/v1/statuses/1', unnest(['https://truthsocial.com/api/v1/truth/videos/v1', 'http://s.test/s.js']), 'asset', 0 FROM k WHERE k = 1
  UNION ALL SELECT 'https://apipartner.ina.fr/assets/1', unnest(['http://s.test/r.mp4', 'http://s.test/t.jpg', 'https://player.ina.fr/e', 'http://s.test/u']), 'asset', 0 FROM k WHERE k = 2
  UNION ALL SELECT 'https://truthsocial.com/@x', unnest(['{_ROOT}exclude_replies=true&only_replies=false&with_muted=true', '{_ROOT}pinned=true&only_replies=false&with_muted=true', '{_ROOT}with_muted=true&only_media=true']), 'outlink', 1 FROM k WHERE k = 3"""


#: address, has a parent, redirects; and what becomes of it.
_SCOPED = [("http://a.test/x", False, 0, "go"), ("http://b.test/", True, 0, "removed"), ("http://archive.org/x", False, 0, "completed"), ("http://archive.org/x", True, 0, "removed"), ("http://a.test/", True, 1, "go"), ("http://a.test/zzz", False, 0, "completed"), ("http://a.test/", False, 0, "go")]


def scope_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "pages").select("page_id", _pick([c[0] for c in _SCOPED]).alias("url"), F.when(_pick([c[1] for c in _SCOPED], "boolean"), "p").alias("parent_id"), _pick([c[2] for c in _SCOPED], "int").alias("redirects"))
    return scope.apply_scope(items, CrawlConfig(exclude_strings=("zzz",))).select("page_id", "outcome")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by tens of pages: the first of a ten is the seed, the others its children in two levels."""
    k, s = F.col("page_id"), F.col("page_id") % 10
    return table(spark, sf_dir, "pages").select(
        k.cast("string").alias("item_id"), (k - s).cast("string").alias("seed_id"), F.when(s.between(1, 4), (k - s).cast("string")).when(s > 4, (k - 4).cast("string")).alias("parent_id"), F.concat(F.lit("http://s.test/"), (k % 7).cast("string")).alias("url"),
        F.lit("").alias("seed_via"), F.when(s == 0, "GotChildren").when(s == 2, "GotRedirected").when(s < 5, "Fresh").otherwise("Completed").alias("status"), F.lit("Queue").alias("source"), (k % 5).cast("int").alias("hops"), F.when(s % 2 == 0, "css").otherwise("html").alias("mime"),
    )


_TREE_SQL = """i AS (SELECT page_id, page_id % 10 AS s, page_id::VARCHAR AS item_id, CASE WHEN page_id % 10 BETWEEN 1 AND 4 THEN (page_id - page_id % 10)::VARCHAR WHEN page_id % 10 > 4 THEN (page_id - 4)::VARCHAR END AS parent_id, 'http://s.test/' || page_id % 7 AS url,
  CASE WHEN page_id % 10 = 0 THEN 'GotChildren' WHEN page_id % 10 = 2 THEN 'GotRedirected' WHEN page_id % 10 < 5 THEN 'Fresh' ELSE 'Completed' END AS status, CASE WHEN page_id % 2 = 0 THEN 'css' ELSE 'html' END AS mime FROM pages)"""


def seen_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote = table(spark, sf_dir, "pages").where("page_id < 3").select(F.concat(F.lit("http://s.test/"), F.col("page_id").cast("string")).alias("url"))
    return seen.remote_check(_tree(spark, sf_dir), remote).select("item_id", "status")


def seen_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen.failed_check(_tree(spark, sf_dir)).select("item_id", "status")


def seen_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses per key: different addresses of the pages have different keys."""
    rows = table(spark, sf_dir, "pages").select("url").distinct()
    return rows.groupBy(seen.url_key(F.col("url")).alias("k")).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("keys"))


def tree_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).where(tree.has_work()).groupBy("seed_id").agg(F.count("*").alias("busy"))


def tree_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _tree(spark, sf_dir)
    return tree.remove(items, items.where("status = 'Completed'")).select("item_id", "status")


def tree_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child for every item of the first level that has none."""
    items = _tree(spark, sf_dir)
    kids = items.where("parent_id IS NOT NULL AND CAST(item_id AS LONG) % 10 = 3").select(*(F.concat("item_id", F.lit("k")).alias(c) if c == "item_id" else F.col("item_id").alias(c) if c == "parent_id" else F.col(c) for c in items.columns))
    return tree.add_children(items, kids, "GotChildren").select("item_id", "status")


def css_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.css_jumps(_tree(spark, sf_dir)).select("item_id", F.col("jumps").cast("long").alias("jumps"))


def redirect_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    items = table(spark, sf_dir, "pages").select(
        k.cast("string").alias("item_id"), k.cast("string").alias("seed_id"), F.lit(302).alias("code"), F.lit("/next").alias("location"), (k % 23).cast("int").alias("redirects"), F.lit(0).alias("plain_depth"), F.lit("text/html").alias("mime"), F.lit(False).alias("embedded_css"), F.lit(None).cast("string").alias("body"), (k % 3).cast("int").alias("hops")
    )
    return fetch.redirect_children(fetch.after_response(items)).select("item_id", "parent_id", "url", "status", F.col("redirects").cast("long").alias("redirects"), F.col("hops").cast("long").alias("hops"))


def sanitized_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ["http://s.test/a.png", _PAGE, "data:image/png,x", "JavaScript:x", "https://s.test/b.js", None]
    rows = table(spark, sf_dir, "pages").select("page_id", _pick(found).alias("url"), F.lit(_PAGE).alias("page_url"))
    return fetch.sanitize(rows).select("page_id", "url")


_LENGTHS = ["1048576", "1048577", "99999999999", "x", None]


def long_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared lengths over a limit of 1 MiB are a reason to discard; bodies are cut at a limit where none is declared."""
    headers = F.create_map(F.lit("content-length"), _pick(_LENGTHS))
    cut = fetch.capped_body(F.col("html").cast("binary"), 100)
    return table(spark, sf_dir, "pages").select("page_id", C.discard_reason(F.lit(200), headers, (), 1).alias("reason"), F.octet_length(cut["body"]).cast("long").alias("n_bytes"), cut["truncated"].alias("truncated"))


#: A gzip member of the word `hello`, one that is cut off, and a plain body.
_ZIPPED = ["1F8B0800000000000203CB48CDC9C907008 6A6103605000000".replace(" ", ""), "1F8B0800", "706C61696E", None]


_POSTS = [
    ("https://www.facebook.com/a/posts/1?x=y z", "https://www.facebook.com/plugins/post.php?href=https%3A%2F%2Fwww.facebook.com%2Fa%2Fposts%2F1%3Fx%3Dy+z&show_text=true"),
    ("https://www.facebook.com/plugins/post.php?href=/posts/1", None), ("https://www.facebook.com/a", None), ("https://facebook.com/a/posts/1", None),
]


def embedded_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sites.embedded_post(_pick([c[0] for c in _POSTS])).alias("embed"))


def opened_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.unhex(_pick(_ZIPPED))
    return table(spark, sf_dir, "pages").select("page_id", F.hex(fetch.gunzip(body)).alias("body"))


def domain_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of JSON bodies: strings inside strings, keys left out, broken bodies."""
    bodies = ['{"a": "http://s.test/x.js", "b": ["see http://s.test/y now", "{\\"c\\": \\"http://s.test/z\\"}"], "http://key.test/": 1}', "nothing", '["https://s.test/p.png"]']
    rows = table(spark, sf_dir, "pages").select("page_id", json_links(_pick(bodies)).alias("j"))
    return rows.select("page_id", F.array_join(F.array_sort("j.assets"), " ").alias("assets"), F.array_join(F.array_sort("j.outlinks"), " ").alias("outlinks"), F.col("j.error").isNotNull().alias("broken"))


def full_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of a crawl, with events as fetches."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(
        F.when(k % 5 == 0, 404).otherwise(200).alias("code"), (k % 900).alias("ms"), (k % 7).alias("bytes"), (k % 3 == 0).alias("seed_done"), F.when(k % 11 == 0, "cloudflare").alias("challenge"), F.col("ts").alias("fetched_at"), (k % 90).alias("body_ms"), (k % 9).alias("process_ms"),
        (k % 4).alias("written"), (k % 2).alias("dedupe_local"), (k % 8).alias("dedupe_remote"), *((k % n == 0).alias(x) for n, x in enumerate(metrics._OPTIONAL, 2)),
    )
    return metrics.snapshot(rows)


_FLAGS = ", ".join(f"count(*) FILTER (k % {n} = 0) AS {x}" for n, x in enumerate(metrics._OPTIONAL.values(), 2))


def least_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("host")).agg(F.count("*").alias("uses"))
    return metrics.least_used(used)


def frontier_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of answers that the queue doesn't have: every third answer is for another one."""
    queue = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"))
    answers = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("x"), F.col("page_id").cast("string"))).otherwise(F.col("page_id").cast("string")).alias("id"))
    return frontier.absent(queue, answers)


def split_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 30 rows of the queue in three requests."""
    k = F.col("page_id")
    queue = table(spark, sf_dir, "pages").select(k.cast("string").alias("id"), F.col("url").alias("value"), F.lit(None).cast("string").alias("via"), (k % 4).cast("int").alias("hops"), F.lit("FRESH").alias("status"), (1000 - k).alias("timestamp"))
    return frontier.split_batches(queue, 31, 3).select("id", F.col("request").cast("long").alias("request"))


def seed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses given at the start, as queue rows."""
    rows = lists.to_frontier(lists.from_urls(spark, ["http://s.test/a", "http://s.test/b", "http://s.test/a"]), 5)
    return rows.select("id", "value", F.col("hops").cast("long").alias("hops"), "status", "timestamp")


def disk_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether disks of some sizes are low, by size and free space in GiB."""
    cases = [(512, 49), (512, 51), (128, 24), (128, 26), (256, 50), (64, 12)]
    rows = [(t, f, fetch.disk_low(t << 30, f << 30), fetch.disk_low(t << 30, f << 30, 20)) for t, f in cases]
    return spark.createDataFrame(rows, "total long, free long, low boolean, under_20 boolean")


def _same(name: str, values: list, kind: str = "VARCHAR") -> str:
    return f"{_sql(values, kind)} AS {name}"


_BELOW = [True, True, False, True]
QUERIES = {
    "url_normal_forms": (url_normal_forms, f"SELECT page_id, {_same('url', [c[2] for c in _NORMAL])}, {_same('error', [c[3] for c in _NORMAL])} FROM pages"),
    "url_forms": (url_forms, f"SELECT page_id, {_same('resolved', [c[2] for c in _RESOLVED])}, {_same('text', [c[1] for c in _TEXTS])}, {_same('valid', [c[1] for c in _VALID], 'BOOLEAN')}, {_same('coded', [c[2] for c in _CODED])} FROM pages"),
    "url_helpers": (url_helpers, f"SELECT page_id, {_same('domain', ['s.test', 's.test', 's.test', 'b.s.test'])}, {_same('below', _BELOW, 'BOOLEAN')}, 'http://s.test/a ' || {_sql(['s.test', 'a.s.test', 'as.test', 'a.b.s.test'])} AS urls FROM pages"),
    "markup_links": (markup_links, f"SELECT page_id, {_same('assets', [c[1] for c in _MARKUP])}, {_same('outlinks', [c[2] for c in _MARKUP])}, {_same('imports', [c[3] for c in _MARKUP])} FROM pages"),
    "disabled_markup": (disabled_markup, """SELECT page_id, 'http://s.test/d/four' AS off_assets, 'http://s.test/d/three' AS off_outlinks, 'http://s.test/static/two http://s.test/d/five http://s.test/d/six' AS on_assets, 'http://s.test/d/one http://s.test/static/two http://s.test/?q=%E9' AS on_outlinks FROM pages"""),
    "running_links": (running_links, f"SELECT page_id, {_same('loose', [c[1] for c in _RUNNING])}, {_same('strict', [c[2] for c in _RUNNING])} FROM pages"),
    "embedded_posts": (embedded_posts, f"SELECT page_id, {_same('embed', [c[1] for c in _POSTS])} FROM pages"),
    "opened_bodies": (opened_bodies, f"SELECT page_id, {_same('body', ['68656C6C6F', '1F8B0800', '706C61696E', None])} FROM pages"),
    "body_links": (body_links, f"SELECT page_id, {_same('links', [c[1] for c in _BODIES])} FROM pages"),
    "site_rules": (site_rules, f"SELECT page_id, {_same('profile', [c[1] for c in _SITES])}, {_same('n_headers', [c[2] for c in _SITES], 'BIGINT')}, {_sql([c[1] for c in _SITES])} IS NOT DISTINCT FROM 'account' AS asks_json, {_same('assets', [c[3] for c in _SITES])}, {_same('outlinks', [c[4] for c in _SITES])} FROM pages"),
    "xml_routes": (xml_routes, f"SELECT page_id, {_same('store', [c[1] for c in _STORES])}, {_same('sitemap', [c[1] for c in _SITEMAPS], 'BOOLEAN')}, CASE WHEN page_id % 3 = 0 THEN 'css' END AS css FROM pages"),
    "mixed_links": (mixed_links, _MIXED_SQL),
    "scope_outcomes": (scope_outcomes, f"SELECT page_id, {_same('outcome', [c[3] for c in _SCOPED])} FROM pages"),
    "seen_remote": (seen_remote, f"WITH {_TREE_SQL} SELECT item_id, CASE WHEN status = 'Fresh' AND parent_id IS NOT NULL AND page_id % 7 < 3 THEN 'Seen' ELSE status END AS status FROM i"),
    "seen_failed": (seen_failed, f"WITH {_TREE_SQL} SELECT item_id, CASE WHEN parent_id IS NULL OR status = 'Fresh' THEN 'Failed' ELSE status END AS status FROM i"),
    "seen_keys": (seen_keys, "SELECT 1::BIGINT AS n, count(DISTINCT url) AS keys FROM pages"),
    "tree_work": (tree_work, f"WITH {_TREE_SQL} SELECT (page_id - s)::VARCHAR AS seed_id, count(*) AS busy FROM i WHERE status NOT IN ('Completed', 'Seen', 'Failed') GROUP BY 1"),
    "tree_removed": (tree_removed, f"WITH {_TREE_SQL} SELECT item_id, status FROM i WHERE status <> 'Completed'"),
    "tree_grown": (tree_grown, f"WITH {_TREE_SQL} SELECT item_id, CASE WHEN s = 3 THEN 'GotChildren' ELSE status END AS status FROM i UNION ALL SELECT item_id || 'k', 'Fresh' FROM i WHERE s = 3"),
    "css_jumps": (css_jumps, f"""WITH RECURSIVE {_TREE_SQL}, u AS (SELECT item_id, parent_id AS at, 0 AS jumps FROM i WHERE mime = 'css' AND parent_id IS NOT NULL
        UNION ALL SELECT u.item_id, i.parent_id, u.jumps + CASE WHEN i.mime = 'css' AND i.status <> 'GotRedirected' THEN 1 ELSE 0 END FROM u JOIN i ON i.item_id = u.at WHERE i.status = 'GotRedirected' OR i.mime = 'css')
        SELECT u.item_id, u.jumps::BIGINT AS jumps FROM u JOIN i ON i.item_id = u.at WHERE i.mime = 'html' AND i.status <> 'GotRedirected'"""),
    "redirect_children": (redirect_children, "SELECT page_id || '/r' AS item_id, page_id::VARCHAR AS parent_id, '/next' AS url, 'Fresh' AS status, page_id % 23 + 1 AS redirects, page_id % 3 AS hops FROM pages WHERE page_id % 23 < 20"),
    "sanitized_assets": (sanitized_assets, "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'http://s.test/a.png' ELSE 'https://s.test/b.js' END AS url FROM pages WHERE page_id % 6 IN (0, 4)"),
    "long_answers": (long_answers, f"SELECT page_id, {_same('reason', [None, 'length', 'length', None, None])}, least(strlen(html), 100)::BIGINT AS n_bytes, strlen(html) > 100 AS truncated FROM pages"),
    "full_snapshot": (full_snapshot, f"""WITH e AS (SELECT event_id AS k, ts FROM events) SELECT count(*) AS urls_crawled, count(*) FILTER (k % 3 = 0) AS seeds_finished, count(*) FILTER (k % 5 > 0) AS http_2xx, 0::BIGINT AS http_3xx, count(*) FILTER (k % 5 = 0) AS http_4xx, 0::BIGINT AS http_5xx,
        count(*) FILTER (k % 11 = 0) AS cloudflare_challenges, 0::BIGINT AS akamai_challenges, floor(avg(k % 900))::BIGINT AS mean_response_ms, sum(k % 7) / 1e9 AS archived_gb, {_FLAGS}, (count(*) // (epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT + 1))::BIGINT AS urls_per_second,
        floor(avg(k % 90))::BIGINT AS mean_body_ms, floor(avg(k % 9))::BIGINT AS mean_process_ms, sum(k % 4)::BIGINT AS written_bytes, count(*) FILTER (k % 4 > 0) AS written_records, sum(k % 2)::BIGINT AS dedupe_local_bytes, count(*) FILTER (k % 2 > 0) AS dedupe_local_records, sum(k % 8)::BIGINT AS dedupe_remote_bytes, count(*) FILTER (k % 8 > 0) AS dedupe_remote_records FROM e"""),
    "least_used": (least_used, "SELECT arg_min(host, (uses, host)) AS host FROM (SELECT user_id::VARCHAR AS host, count(*) AS uses FROM events GROUP BY 1)"),
    "frontier_absent": (frontier_absent, "SELECT 'x' || page_id AS id FROM pages WHERE page_id % 3 = 0"),
    "split_requests": (split_requests, "SELECT id, (n - 1) // 10 AS request FROM (SELECT page_id::VARCHAR AS id, row_number() OVER (ORDER BY page_id % 4, 1000 - page_id, page_id::VARCHAR) AS n FROM pages) WHERE n <= 30"),
    "seed_queue": (seed_queue, "SELECT sha256(value) AS id, value, 0::BIGINT AS hops, 'FRESH' AS status, 5::BIGINT AS timestamp FROM (VALUES ('http://s.test/a'), ('http://s.test/b')) v(value)"),
    "disk_limits": (disk_limits, "SELECT * FROM (VALUES (512::BIGINT, 49::BIGINT, true, false), (512, 51, false, false), (128, 24, true, false), (128, 26, false, false), (256, 50, false, false), (64, 12, true, true)) v(total, free, low, under_20)"),
    "json_bodies": (domain_json, f"SELECT page_id, {_same('assets', ['http://s.test/x.js', '', 'https://s.test/p.png'])}, {_same('outlinks', ['http://s.test/y http://s.test/z', '', ''])}, page_id % 3 = 1 AS broken FROM pages"),
}
