"""Fetching by replay, and what becomes of each response.

There is no live network: a Fetcher joins a round's URLs with a table of captured responses. Anything
with `fetch(urls) -> responses` can stand in for it.
"""

from __future__ import annotations

import gzip
import zlib
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dredge.config import CrawlConfig
from dredge.functions import columns as C
from dredge.operators.store import written


class Fetcher(Protocol):
    def fetch(self, urls: DataFrame) -> DataFrame: ...


class ReplayFetcher:
    """Joins on URL with captured responses (url, status, headers, body); the first attempt comes first.

    Bodies stay in the captured table until here, so no earlier shuffle carries them. The first fetch writes the
    table in order of URL; a fetch reads of it the range of its URLs, and only what it asks for is shuffled.
    """

    def __init__(self, responses: DataFrame) -> None:
        self.responses = responses if "attempt" in responses.columns else responses.withColumn("attempt", F.lit(0))
        self.ordered: DataFrame | None = None

    def fetch(self, urls: DataFrame) -> DataFrame:
        if self.ordered is None:
            self.ordered = written(self.responses.repartitionByRange("url").sortWithinPartitions("url"), "responses")
        low, high = urls.agg(F.min("url"), F.max("url")).first()
        asked = self.ordered.where(F.col("url").between(low, high)).join(urls.select("url"), "url", "left_semi")
        return urls.join(asked, "url", "left")


def outcome(attempts: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """One row per URL: the first attempt that ends the retries, its discard reason, and the result.

    attempts: url, attempt, status (null: transport error), headers. An attempt is tried again while it is
    a transport error, a bad code or a retryable challenge, up to max_retry retries. result is
    archived, discarded or failed; waited is the seconds slept between attempts.
    """
    known = attempts.where(F.col("attempt") <= config.max_retry)
    reason = C.discard_reason(F.col("status"), F.col("headers"), config.discard_status, config.max_content_length_mib)
    marked = known.withColumn("discard_reason", reason)
    again = F.col("status").isNull() | C.bad_code(F.col("status")) | F.coalesce(F.col("discard_reason") == "cloudflare", F.lit(False))
    marked = marked.withColumn("ends", ~again)
    chosen = marked.groupBy("url").agg(
        F.min(F.when(F.col("ends"), F.struct("attempt", "status", "discard_reason"))).alias("end"),
        F.max(F.struct("attempt", "status", "discard_reason")).alias("last"),
    )
    end = F.coalesce("end", "last")
    result = F.when(F.col("end").isNull(), "failed").when(F.col("end.discard_reason").isNotNull(), "discarded").otherwise("archived")
    n = end["attempt"]
    return chosen.select("url", n.alias("attempt"), end["status"].alias("status"), end["discard_reason"].alias("discard_reason"), result.alias("result"), (n * (n - 1)).cast("int").alias("waited"))


def sniff(body: Column) -> Column:
    """Media type by the first bytes, for responses without a content type."""
    head = F.hex(F.substring(body, 1, 16))
    start = F.lower(F.trim(F.decode(F.substring(body, 1, 512), "ISO-8859-1")))
    return (
        F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("47494638"), "image/gif").when(head.startswith("1F8B"), "application/gzip").when(head.startswith("504B0304"), "application/zip")
        .when(start.rlike(r"^(<!doctype html|<html|<head|<body)"), "text/html").when(start.startswith("<?xml"), "text/xml").when(start.startswith("#extm3u"), "application/vnd.apple.mpegurl")
        .when(start.rlike(r"^[{\[]"), "application/json").when(~F.decode(F.substring(body, 1, 512), "ISO-8859-1").rlike(r"[\x00-\x08]"), "text/plain").otherwise("application/octet-stream")
    )


def mime(headers: Column, body: Column) -> Column:
    declared = F.lower(F.trim(F.substring_index(F.element_at(headers, "content-type"), ";", 1)))
    return F.when(declared.isNotNull() & (declared != ""), declared).otherwise(sniff(body))


def retain(body: Column, mime_: Column) -> Column:
    """The body if links can be found in it, else null."""
    return F.when(C.keeps_body(mime_), body)


@F.pandas_udf(T.BinaryType())
def gunzip(body: pd.Series) -> pd.Series:
    """Bodies that are gzip members, opened; others, and broken ones, as they are."""

    def opened(b: bytes | None) -> bytes | None:
        if b is None or bytes(b[:2]) != b"\x1f\x8b":
            return b
        try:
            return gzip.decompress(bytes(b))
        except (OSError, EOFError, zlib.error):
            return b

    return body.map(opened)


def capped_body(body: Column, max_bytes: int) -> Column:
    """struct(body, truncated): at most max_bytes of a body whose length wasn't declared; all of it if the limit is 0."""
    long = F.octet_length(body) > max_bytes if max_bytes > 0 else F.lit(False)
    return F.struct(F.when(long, F.substring(body, 1, max_bytes)).otherwise(body).alias("body"), long.alias("truncated"))


def after_response(items: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """What a fetched item becomes: next is redirect, extract or none; state is its new status.

    items: status code `code`, location, redirects, plain_depth, mime, embedded_css, body. Redirects come
    first; then the depth and asset gates, which do not hold in a domain crawl; then code 200.
    """
    crawling = F.lit(bool(config.domains_crawl))
    redirect = C.is_redirect(F.col("code")) & F.col("location").isNotNull()
    deep = ~crawling & (F.col("plain_depth") > 2) & ~F.col("embedded_css")
    framed = ~crawling & (F.col("plain_depth") == 1) & F.lower("mime").contains("html")
    closed = ~crawling & F.lit(config.disable_assets)
    ok = (F.col("code") == 200) | (F.lit(config.headless) & F.col("body").isNotNull())
    following = F.when(redirect & (F.col("redirects") < config.max_redirect), "redirect").when(redirect | deep | framed | closed | ~ok, "none").otherwise("extract")
    state = F.when(F.col("next") == "redirect", "GotRedirected").when(F.col("next") == "none", "Completed").otherwise("Archived")
    return items.withColumn("next", following).withColumn("state", state)


def redirect_children(items: DataFrame) -> DataFrame:
    """Children for redirects: the location as written, one more redirect, the same hops."""
    return items.where("next = 'redirect'").select(
        F.concat("item_id", F.lit("/r")).alias("item_id"), "seed_id", F.col("item_id").alias("parent_id"), F.col("location").alias("url"), F.lit(None).cast("string").alias("seed_via"),
        F.lit("Fresh").alias("status"), F.lit("Postprocess").alias("source"), "hops", (F.col("redirects") + 1).alias("redirects"),
    )


def headless_policy(requests: DataFrame, seen: DataFrame) -> DataFrame:
    """Verdict on a page's sub-requests: block what was seen and is media, other methods and schemes; else load."""
    marked = requests.join(seen.select("url").distinct().withColumn("__s", F.lit(True)), "url", "left")
    media = F.col("type").isin("image", "media", "font", "stylesheet")
    bad = ~F.upper("method").isin("GET", "HEAD", "POST", "OPTIONS") | ~C.supported_scheme(F.col("url"))
    return marked.withColumn("verdict", F.when(bad, "block").when(F.col("__s").isNotNull() & (F.upper("method") == "GET") & media, "block").otherwise("load")).drop("__s")


def disk_low(total: int, free: int, min_gb: float = 0) -> bool:
    """Whether free bytes are below the minimum: the given one, or 50 GB in proportion for disks under 256 GB."""
    gib = 1 << 30
    least = min_gb * gib if min_gb > 0 else min(50.0, 50.0 * total / (256 * gib)) * gib
    return free < least


def sanitize(links: DataFrame, page_hops: str = "hops") -> DataFrame:
    """Asset links (url, page_url, hops) without the page itself and without schemes that are never fetched."""
    return links.where(F.col("url").isNotNull() & (F.col("url") != F.col("page_url")) & ~C.skipped_protocol(F.col("url")))


def cap_outlinks(links: DataFrame, limit: int, page: tuple[str, ...] = ("page_url",)) -> DataFrame:
    """The first `limit` outlinks of each page by position; all if the limit is 0.

    `page` names the columns that tell pages apart: an address alone doesn't where two pages have the same. A
    page has one link at a position.
    """
    if limit <= 0:
        return links
    return links.withColumn("__n", F.dense_rank().over(Window.partitionBy(*page).orderBy("pos"))).where(F.col("__n") <= limit).drop("__n")
