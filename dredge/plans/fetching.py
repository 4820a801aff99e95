"""Queries of fetch outcomes, rate limits and the replayed crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.config import CrawlConfig
from dredge.functions import columns as C
from dredge.job import CrawlJob
from dredge.operators import fetch, ratelimit
from dredge.operators.fetch import ReplayFetcher
from dredge.plans.base import ENCODED_SQL, HREFS_SQL, ORIGIN_SQL, table


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts: three per URL, with codes and headers by number."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, (200, 503, 403, 301, 429, 404, 403, 0, 500, 200, 503))), (k % 11 + 1).cast("int"))
    headers = F.when(k % 11 == 2, F.create_map(F.lit("cf-mitigated"), F.lit("challenge"))).when(k % 11 == 6, F.create_map(F.lit("server"), F.lit("AkamaiGHost"))).otherwise(F.create_map().cast("map<string,string>"))
    return e.select(F.floor(k / 3).cast("string").alias("url"), (k % 3).cast("int").alias("attempt"), F.when(status > 0, status).alias("status"), headers.alias("headers"), "event_id")


def discards(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _attempts(spark, sf_dir)
    reason = C.discard_reason(F.col("status"), F.col("headers"))
    return a.select("event_id", reason.alias("reason"), C.retryable(reason, F.col("status")).alias("retryable"), C.bad_code(F.col("status")).alias("bad"), C.is_redirect(F.col("status")).alias("redirect"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fetch.outcome(_attempts(spark, sf_dir))
    return o.select("url", F.col("attempt").cast("long").alias("attempt"), F.col("status").cast("long").alias("status"), "discard_reason", "result", F.col("waited").cast("long").alias("waited"))


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("text/html", "image/png", "application/json", "application/pdf", "video/mp4")))
    mime = F.element_at(kinds, (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length(fetch.retain(F.col("html"), mime)).cast("long").alias("kept"), C.mime_class(mime).alias("kind"), fetch.sniff(F.col("html").cast("binary")).alias("sniffed"))


def after_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    code = F.element_at(F.array(*map(F.lit, (200, 301, 404, 200))), (k % 4 + 1).cast("int"))
    items = table(spark, sf_dir, "pages").select(
        "page_id", code.alias("code"), F.when(code == 301, "/next").alias("location"), (k % 23).cast("int").alias("redirects"), (k % 5 - 1).cast("int").alias("plain_depth"), F.lit("text/html").alias("mime"), (k % 2 == 0).alias("embedded_css"), F.lit("x").alias("body")
    )
    return fetch.after_response(items).select("page_id", "next", "state")


def subrequests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, ("image", "script", "font"))), (k % 3 + 1).cast("int"))
    method = F.element_at(F.array(*map(F.lit, ("GET", "POST", "TRACE", "GET"))), (k % 4 + 1).cast("int"))
    requests = table(spark, sf_dir, "pages").select("page_id", "url", kind.alias("type"), method.alias("method"))
    known = table(spark, sf_dir, "pages").where("page_id % 2 = 0").select("url")
    return fetch.headless_policy(requests, known).select("page_id", "verdict")


def token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests to a host per user: the bucket after each."""
    e = table(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "error", 503).when(F.col("event_id") % 97 == 0, 429).otherwise(200)
    return ratelimit.replay(e.select(F.col("user_id").cast("string").alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), code.alias("code"), F.col("event_id").alias("seq")).withColumn("ts", F.col("us") / 1e6))


def replayed_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl over the pages as captured responses, from every page, following their links one hop."""
    pages = table(spark, sf_dir, "pages")
    responses = pages.select(C.strip_fragment(F.col("url")).alias("url"), F.lit(200).alias("status"), F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8")).alias("headers"), F.col("html").cast("binary").alias("body"), F.col("page_id"))
    responses = responses.groupBy("url").agg(F.min_by(F.struct("status", "headers", "body"), "page_id").alias("r")).select("url", "r.*")
    result = CrawlJob(spark, CrawlConfig(max_hops=1), ReplayFetcher(responses)).run(pages.select(F.col("url").alias("value")))
    return result.captures.select("url", "kind", F.col("hops").cast("long").alias("hops"), F.col("status").cast("long").alias("status"), "result", "digest")


_A = """a AS (SELECT event_id, (event_id // 3)::VARCHAR AS url, event_id % 3 AS attempt, nullif([200, 503, 403, 301, 429, 404, 403, 0, 500, 200, 503][event_id % 11 + 1], 0) AS status, event_id % 11 = 2 AS cf, event_id % 11 = 6 AS ak FROM events),
  b AS (SELECT *, CASE WHEN status = 403 AND cf THEN 'cloudflare' WHEN status = 403 AND ak THEN 'akamai' WHEN status = 429 THEN 'status' END AS reason, status >= 500 OR status IN (408, 425, 429) AS bad FROM a)"""
#: One request after the other per host: when it starts (a), refills (b, c), token taken (d), and what the answer does.
_BUCKETS = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS host, epoch_us(ts)::DOUBLE / 1e6 AS ts, CASE WHEN event_type = 'error' THEN 503 WHEN event_id % 97 = 0 THEN 429 ELSE 200 END AS code, event_id AS seq FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, seq) AS i FROM e),
  s AS (SELECT host, 0::BIGINT AS i, NULL::BIGINT AS seq, ts, NULL::INT AS code, NULL::DOUBLE AS start, 150.0::DOUBLE AS tokens, 50.0::DOUBLE AS rate, ts AS last, '-infinity'::DOUBLE AS until, 0 AS failures FROM n WHERE i = 1
    UNION ALL SELECT host, i, seq, ts, code, w2 AS start,
      CASE WHEN code IN (429, 403, 408, 425) OR code >= 500 THEN 0.0 ELSE t3 END,
      CASE WHEN code IN (429, 403, 408, 425) THEN rate WHEN code >= 500 THEN greatest(rate * power(0.5, failures + 1), 0.5) WHEN w2 > until THEN least(50.0, rate + (50.0 - rate) * 0.1) ELSE rate END,
      l2, CASE WHEN code IN (429, 403, 408, 425) THEN w2 + least(5.0 * power(2, failures), 30.0) ELSE until END,
      CASE WHEN code IN (429, 403, 408, 425) OR code >= 500 THEN failures + 1 WHEN w2 > until THEN greatest(0, failures - 1) ELSE failures END
    FROM (SELECT *, greatest(0.0, CASE WHEN short AND w2 >= until AND w2 - greatest(l1, until) > 0 THEN least(150.0, t1 + (w2 - greatest(l1, until)) * rate) ELSE t1 END - 1) AS t3,
        CASE WHEN short AND w2 >= until AND w2 - greatest(l1, until) > 0 THEN w2 ELSE l1 END AS l2
      FROM (SELECT *, t1 < 1 AS short, CASE WHEN t1 < 1 THEN w1 + (1 - t1) / rate ELSE w1 END AS w2
        FROM (SELECT *, CASE WHEN w1 >= until AND w1 - greatest(last, until) > 0 THEN least(150.0, tokens + (w1 - greatest(last, until)) * rate) ELSE tokens END AS t1, CASE WHEN w1 >= until AND w1 - greatest(last, until) > 0 THEN w1 ELSE last END AS l1
          FROM (SELECT n.host, n.i, n.seq, n.ts, n.code, s.tokens, s.rate, s.last, s.until, s.failures, greatest(n.ts, CASE WHEN s.tokens < 1 THEN s.until ELSE n.ts END) AS w1 FROM s JOIN n ON n.host = s.host AND n.i = s.i + 1)))))
  SELECT host, seq, ts, code::INT AS code, start, tokens, rate, CASE WHEN until > '-infinity'::DOUBLE THEN until END AS penalty_until, failures::INT AS failures FROM s WHERE i > 0"""
QUERIES = {
    "discards": (discards, f"WITH {_A} SELECT event_id, reason, CASE WHEN reason = 'cloudflare' THEN true ELSE bad END AS retryable, bad, status IN (300, 301, 302, 303, 307, 308) AS redirect FROM b"),
    "fetch_outcomes": (outcomes, f"""WITH {_A}, c AS (SELECT *, NOT (status IS NULL OR bad OR coalesce(reason = 'cloudflare', false)) AS ends FROM b), d AS (SELECT url, min(attempt) FILTER (ends) AS e, max(attempt) AS l FROM c GROUP BY 1)
        SELECT d.url, c.attempt, c.status, c.reason AS discard_reason, CASE WHEN e IS NULL THEN 'failed' WHEN c.reason IS NOT NULL THEN 'discarded' ELSE 'archived' END AS result, c.attempt * (c.attempt - 1) AS waited FROM d JOIN c ON c.url = d.url AND c.attempt = coalesce(e, l)"""),
    "retained_bodies": (retained, """SELECT page_id, CASE WHEN page_id % 5 IN (0, 2, 3) THEN strlen(html) END AS kept, ['html', 'other', 'json', 'pdf', 'other'][page_id % 5 + 1] AS kind, 'text/html' AS sniffed FROM pages"""),
    "after_response": (after_response, """WITH p AS (SELECT page_id, [200, 301, 404, 200][page_id % 4 + 1] AS code, page_id % 23 AS r, page_id % 5 - 1 AS d, page_id % 2 = 0 AS css FROM pages),
        q AS (SELECT page_id, CASE WHEN code = 301 AND r < 20 THEN 'redirect' WHEN code = 301 OR (d > 2 AND NOT css) OR d = 1 OR code <> 200 THEN 'none' ELSE 'extract' END AS next FROM p) SELECT page_id, next, CASE next WHEN 'redirect' THEN 'GotRedirected' WHEN 'none' THEN 'Completed' ELSE 'Archived' END AS state FROM q"""),
    "subrequests": (subrequests, """WITH p AS (SELECT page_id, url, page_id % 3 IN (0, 2) AS media, ['GET', 'POST', 'TRACE', 'GET'][page_id % 4 + 1] AS m FROM pages), s AS (SELECT DISTINCT url FROM pages WHERE page_id % 2 = 0)
        SELECT page_id, CASE WHEN m = 'TRACE' THEN 'block' WHEN url IN (SELECT url FROM s) AND m = 'GET' AND media THEN 'block' ELSE 'load' END AS verdict FROM p"""),
    "token_buckets": (token_buckets, _BUCKETS),
    "replayed_crawl": (replayed_crawl, f"""WITH {HREFS_SQL}, p AS (SELECT regexp_replace(url, '#.*$', '') AS url, arg_min(html, page_id) AS html FROM pages GROUP BY 1),
        o AS (SELECT DISTINCT regexp_replace({ORIGIN_SQL.format('h.url')} || {ENCODED_SQL.format('href')}, '#.*$', '') AS url FROM hrefs h WHERE page_id IN (SELECT min(page_id) FROM pages GROUP BY regexp_replace(url, '#.*$', '')))
        SELECT url, 'seed' AS kind, 0::BIGINT AS hops, 200::BIGINT AS status, 'archived' AS result, sha256(html) AS digest FROM p
        UNION ALL SELECT url, 'seed', 1, NULL, 'failed', NULL FROM o WHERE url NOT IN (SELECT url FROM p)"""),
}
