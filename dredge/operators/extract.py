"""Dispatch of responses to link extractors, and the union of what they find.

Each response goes to the first asset extractor and the first outlink extractor that match. Rows are
routed by a native column first, so a Python extractor only sees the rows of its own kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dredge.config import CrawlConfig
from dredge.functions import columns as C
from dredge.functions.css_links import css_links
from dredge.functions.html_links import html_links
from dredge.functions.json_links import json_links
from dredge.functions.pdf_links import pdf_links
from dredge.functions.xml_links import AZURE_SERVERS, S3_SERVERS, SITEMAP_MARK, listing_links, xml_links
from dredge.operators import sites
from dredge.operators.store import written


def asset_extractor(url: Column, mime: Column, text: Column, embedded_css: Column | None = None) -> Column:
    """Name of the asset extractor: media API, status, post, playlist, JSON, XML, HTML, CSS, or null.

    Style sheets only count where they are embedded, that is linked from a page, at once or by imports.
    """
    kind = C.mime_class(mime)
    embedded = F.lit(True) if embedded_css is None else F.coalesce(embedded_css, F.lit(False))
    return (
        F.when(sites.media_api(url), "media").when(url.rlike(sites.STATUS_URL), "status").when(url.rlike(sites.POST_PAGE), "post_page").when(kind == "m3u8", "m3u8")
        .when(kind == "json", "json").when((kind == "xml") & ~text.contains(SITEMAP_MARK), "xml").when(kind == "html", "html").when((kind == "css") & embedded, "css")
    )


def outlink_extractor(url: Column, mime: Column, server: Column, text: Column) -> Column:
    """Name of the outlink extractor: account, lookup, object store, sitemap, HTML, PDF, post listing, or null.

    An account is looked for in the answer of any address below a profile; a lookup's answer has no outlinks.
    """
    kind = C.mime_class(mime)
    store = C.contains_any(F.coalesce(server, F.lit("")), (*S3_SERVERS, *AZURE_SERVERS)) & F.lower(mime).contains("/xml")
    return (
        F.when(url.rlike(sites.PROFILE_URL), "account").when(url.rlike(sites.LOOKUP_URL), "lookup").when(store, "store").when(text.contains(SITEMAP_MARK), "sitemap")
        .when(kind == "html", "html").when(kind == "pdf", "pdf").when(url.contains("reddit.com/api/info.json?id=t3_"), "post")
    )


def _typed(urls: Column, kind: str, tag: str) -> Column:
    return F.transform(urls, lambda u: F.struct(u.alias("url"), F.lit(kind).alias("kind"), F.lit(tag).alias("tag")))


def links(responses: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """(page_url, url, kind, tag, pos, hops) of all links of responses.

    responses: url, mime, headers, text (decoded body) and hops; also charset and embedded_css if known (else
    style sheets count as embedded). kind is asset, outlink or import. Assets keep the page's hops, outlinks
    get one more. Outlinks of one page are capped before those found
    among its assets join. A column context is handed through. The rows are classified and written once;
    every extractor then reads its own. Skipped schemes, the page itself and empty links are gone.
    """
    marked = responses.select(
        F.col("url").alias("page_url"), "mime", "headers", "text", "hops", *(["context"] if "context" in responses.columns else []), (F.col("charset") if "charset" in responses.columns else F.lit(None).cast("string")).alias("charset"),
        asset_extractor(F.col("url"), F.col("mime"), F.col("text"), F.col("embedded_css") if "embedded_css" in responses.columns else None).alias("asset_by"),
        outlink_extractor(F.col("url"), F.col("mime"), F.element_at("headers", "server"), F.col("text")).alias("outlink_by"),
    )
    base = ["page_url", "hops"]
    if "context" in responses.columns:
        base.append("context")
    if config.max_outlinks > 0:
        # Written with the rows, so that responses with one address are capped each by itself.
        marked = marked.withColumn("__page", F.monotonically_increasing_id())
    marked = written(marked, "answers")
    text, page = F.col("text"), F.col("page_url")
    context = base[2:]
    if config.max_outlinks > 0:
        base.append("__page")

    def flat(rows: DataFrame, array: Column, rank: int) -> DataFrame:
        found = rows.select(*base, F.posexplode(array).alias("pos", "link"))
        return found.select(*base, "link.url", "link.kind", "link.tag", (F.col("pos") + rank * 1_000_000).alias("pos"))

    parts: list[DataFrame] = []
    # A page may be markup for its assets, for its outlinks, or both; only these kinds are taken.
    for_assets, for_outlinks = F.col("asset_by").isin("html", "media", "post_page"), F.col("outlink_by") == "html"
    html = marked.withColumn("html_for", F.when(for_assets & F.coalesce(for_outlinks, F.lit(False)), "both").when(for_assets, "assets").when(for_outlinks, "outlinks")).where("html_for IS NOT NULL")
    of_page = html_links(text, page, config.disable_html_tags, config.capture_alternate_pages, config.strict_regex, F.col("charset"))
    found = html.select(*base, "html_for", of_page.alias("l"))
    wanted = F.filter("l", lambda x: (F.col("html_for") == "both") | ((F.col("html_for") == "outlinks") == (x["kind"] == "outlink")))
    parts.append(flat(found, wanted, 0))

    def split(rows: DataFrame, parsed: Column, tag: str) -> DataFrame:
        done = rows.select(*base, parsed.alias("s"))
        return flat(done, F.concat(_typed(F.col("s.assets"), "asset", tag), _typed(F.col("s.outlinks"), "found", tag)), 0)

    parts.append(split(marked.where("asset_by = 'json'"), json_links(text), "json"))
    parts.append(split(marked.where("asset_by = 'xml'"), xml_links(text), "xml"))
    sitemap = marked.where("outlink_by = 'sitemap'").select(*base, xml_links(text).alias("s"))
    parts.append(flat(sitemap, _typed(F.concat("s.outlinks", "s.assets"), "outlink", "sitemap"), 0))
    css = marked.where("asset_by = 'css'").select(*base, css_links(text).alias("s"))
    parts.append(flat(css, F.concat(_typed(F.col("s.links"), "asset", "css"), _typed(F.col("s.imports"), "import", "css")), 0))
    parts.append(flat(marked.where("asset_by = 'm3u8'"), _typed(C.playlist_links(text), "asset", "m3u8"), 0))
    parts.append(flat(marked.where("asset_by = 'media'"), _typed(sites.media_assets(text), "asset", "media"), 0))
    none = F.array().cast("array<string>")
    status = marked.where("asset_by = 'status'").select(*base, "text", json_links(text).alias("s"))
    parts.append(flat(status, _typed(F.concat(F.coalesce(sites.status_videos(text), none), F.coalesce("s.assets", none)), "asset", "status"), 0))
    parts.append(flat(marked.where("asset_by = 'post_page'"), _typed(F.filter(F.array(sites.post_status(page)), lambda x: x.isNotNull()), "asset", "post_page"), 0))
    store = marked.where("outlink_by = 'store'")
    parts.append(flat(store, _typed(listing_links(page, F.element_at("headers", "server"), text), "outlink", "store"), 0))
    parts.append(flat(marked.where("outlink_by = 'pdf'"), _typed(pdf_links(text), "outlink", "pdf"), 0))
    parts.append(flat(marked.where("outlink_by = 'account'"), _typed(sites.account_statuses(text), "outlink", "account"), 0))
    parts.append(flat(marked.where("outlink_by = 'post'"), _typed(sites.post_permalinks(text), "outlink", "post"), 0))
    header = marked.where(F.element_at("headers", "link").isNotNull())
    parts.append(flat(header, _typed(C.link_header(F.element_at("headers", "link")), "outlink", "header"), 1))
    plain = marked.where(F.lower(F.coalesce(F.element_at("headers", "content-type"), F.col("mime"))).contains("text/") & text.contains("://"))
    parts.append(flat(plain, _typed(C.body_links(text, config.strict_regex), "outlink", "text"), 2))

    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.where(F.col("url").isNotNull() & (F.col("url") != "") & (F.col("url") != F.col("page_url")) & ~C.skipped_protocol(F.col("url")))
    every = sites.repair_assets(every)
    if config.max_outlinks > 0:
        from dredge.operators.fetch import cap_outlinks

        every = cap_outlinks(every.where("kind = 'outlink'"), config.max_outlinks, ("__page",)).unionByName(every.where("kind <> 'outlink'"))
    kind = F.when(F.col("kind") == "found", "outlink").otherwise(F.col("kind"))
    hops = F.when(kind == "outlink", F.col("hops") + 1).otherwise(F.col("hops"))
    return every.select("page_url", "url", kind.alias("kind"), "tag", "pos", hops.alias("hops"), *context)
