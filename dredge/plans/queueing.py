"""Queries of the frontier, the seen-set, captures, metrics and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.functions import columns as C
from dredge.operators import archive, frontier, metrics, seen
from dredge.plans.base import TARGETS_SQL, table, targets
from dredge.sources import lists

NOW = 1_700_000_000


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as queue rows; every seventh is claimed."""
    key = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), key.cast("string")).alias("id"), C.strip_fragment(F.col("url")).alias("value"), F.lit(None).cast("string").alias("via"), (key % 4).cast("int").alias("hops"),
        F.when(key % 7 == 0, "CLAIMED").otherwise("FRESH").alias("status"), (NOW - key % 50).alias("timestamp"),
    )


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of all anchors as rows to queue."""
    t = targets(spark, sf_dir)
    key = F.concat(F.col("page_id").cast("string"), F.lit("-"), F.col("pos").cast("string"))
    return t.select(key.alias("id"), C.strip_fragment(F.col("target")).alias("value"), F.col("url").alias("via"), (F.col("page_id") % 3).cast("int").alias("hops"), F.lit("FRESH").alias("status"), F.lit(NOW).cast("long").alias("timestamp"))


_OUT = ("id", "value", "hops", "status", "timestamp")


def _flat(df: DataFrame) -> DataFrame:
    return df.select("id", "value", F.col("hops").cast("long").alias("hops"), "status", "timestamp")


def frontier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(frontier.pick(_frontier(spark, sf_dir), 40))


def frontier_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frontier(spark, sf_dir)
    return _flat(frontier.claim(f, frontier.pick(f, 40), NOW + 1))


def frontier_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frontier(spark, sf_dir)
    return _flat(frontier.reset(f, frontier.in_flight(f), NOW + 2))


def frontier_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frontier(spark, sf_dir)
    return _flat(frontier.done(f, frontier.in_flight(f), NOW + 3))


def frontier_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frontier(spark, sf_dir)
    return _flat(frontier.delete(f, frontier.in_flight(f)))


def frontier_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(frontier.add(_frontier(spark, sf_dir), _found(spark, sf_dir)))


def frontier_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frontier(spark, sf_dir)
    return frontier.already_in_flight(f.where("hops = 0"), f).select("id")


def frontier_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.duplicate_ids(_found(spark, sf_dir).withColumn("id", F.col("value")))


def remote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.to_remote(_frontier(spark, sf_dir)).select("id", "path", "value")


def queue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frontier(spark, sf_dir).withColumn("value", F.when(F.col("hops") == 3, F.lit("not a url")).otherwise(F.col("value")))
    items, broken = frontier.to_items(f)
    return items.select(F.col("item_id").alias("id"), "status", "source").unionByName(broken.select("id", F.lit("Finished").alias("status"), F.lit("Queue").alias("source")))


def seen_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "pages").select(C.strip_fragment(F.col("url")).alias("url"), F.when(F.col("page_id") % 2 == 0, "asset").otherwise("seed").alias("kind"))
    t = targets(spark, sf_dir)
    mine = t.select(C.strip_fragment(F.col("target")).alias("url"), F.when(F.col("pos") % 2 == 0, "asset").otherwise("seed").alias("kind"), "page_id", "pos")
    pages = table(spark, sf_dir, "pages").select(C.strip_fragment(F.col("url")).alias("url"), F.lit("seed").alias("kind"), "page_id", F.lit(-1).alias("pos"))
    return seen.check(mine.unionByName(pages), known, ["page_id", "pos"]).select("page_id", F.col("pos").cast("long").alias("pos"), "url", "verdict")


def seen_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "pages").select(C.strip_fragment(F.col("url")).alias("url"), F.lit("asset").alias("kind"))
    new = targets(spark, sf_dir).select(C.strip_fragment(F.col("target")).alias("url"), F.when(F.col("pos") == 0, "seed").otherwise("asset").alias("kind"))
    return seen.merge(known, new)


def payload_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), "doc_id", F.col("text").alias("body"))
    return archive.revisits(docs, ["doc_id"]).select("doc_id", "digest", "revisit_of")


def payload_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), "doc_id", F.col("text").alias("body"))
    return archive.totals(archive.revisits(docs, ["doc_id"]))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    code = F.element_at(F.array(*map(F.lit, (200, 301, 404, 429, 503, 200, 200))), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", "ts", "user_id", "event_type", code.alias("code"), F.floor(F.abs("value")).cast("long").alias("ms"), (F.col("event_id") % 100).alias("bytes"), (F.col("event_id") % 9 == 0).alias("seed_done"), F.when(code == 429, "cloudflare").alias("challenge"))


def rate_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rate(_events(spark, sf_dir), "ts", every="1 hour").select(F.unix_timestamp("start").alias("start"), "n")


def rate_per_second_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rate(_events(spark, sf_dir), "ts", "event_type").select(F.unix_timestamp("start").alias("start"), "event_type", "n")


def totals_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.totals(_events(spark, sf_dir), "event_type")


def glob_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.filtered_sum(_events(spark, sf_dir), "event_type", "*i?k*")


def status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.status_classes(_events(spark, sf_dir))


def mean_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(metrics.mean(F.col("ms")).alias("mean_ms"), metrics.counter(F.col("bytes")).alias("bytes"))


def response_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = metrics.histogram(_events(spark, sf_dir).withColumn("ms", F.col("ms") + 0.5), "ms")
    return h.select(F.when(F.col("le") < 1e9, F.round("le", 6)).alias("le"), "n")


def metrics_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.snapshot(_events(spark, sf_dir)).withColumn("archived_gb", F.round("archived_gb", 9))


def last_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_n(_events(spark, sf_dir).select("event_id", "event_type"), 64, "event_id")


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("time="), F.col("event_id").cast("string"), F.when(F.col("event_id") % 5 == 0, "").otherwise(" level=INFO"), F.lit(' msg="got \\"it\\" now" type='), F.col("event_type"), F.when(F.col("event_id") % 11 == 0, " type=twice").otherwise(""))
    parsed = lists.logfmt(table(spark, sf_dir, "events").select("event_id", line.alias("value")))
    return parsed.select("event_id", F.element_at("record", "msg").alias("msg"), F.element_at("record", "type").alias("type"), "duplicate")


def list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit(" # "), "url")).when(F.col("page_id") % 5 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), "url", F.lit(" ")))
    return lists.list_lines(table(spark, sf_dir, "pages").select("page_id", line.alias("value")))


_F = "f AS (SELECT 'p' || page_id AS id, regexp_replace(url, '#.*$', '') AS value, url AS via, page_id % 4 AS hops, CASE WHEN page_id % 7 = 0 THEN 'CLAIMED' ELSE 'FRESH' END AS status, 1700000000 - page_id % 50 AS timestamp FROM pages)"
_N = TARGETS_SQL + ", n AS (SELECT page_id || '-' || pos AS id, regexp_replace(target, '#.*$', '') AS value, page_id % 3 AS hops, 'FRESH' AS status, 1700000000::BIGINT AS timestamp FROM targets)"
_PICK = "(SELECT id FROM f WHERE status = 'FRESH' ORDER BY hops, timestamp, id LIMIT 40)"
_SET = "WITH {f} SELECT id, value, hops, CASE WHEN {hit} THEN '{status}' ELSE status END AS status, CASE WHEN {hit} THEN {now} ELSE timestamp END AS timestamp FROM f"
_E = "e AS (SELECT *, [200, 301, 404, 429, 503, 200, 200][event_id % 7 + 1] AS code, floor(abs(value))::BIGINT AS ms, event_id % 100 AS bytes FROM events)"
_RANK = "max(CASE WHEN kind = 'seed' THEN 1 ELSE 0 END)"
QUERIES = {
    "frontier_topk": (frontier_topk, f"WITH {_F} SELECT id, value, hops, status, timestamp FROM f WHERE status = 'FRESH' ORDER BY hops, timestamp, id LIMIT 40"),
    "frontier_claim": (frontier_claim, _SET.format(f=_F, hit=f"id IN {_PICK}", status="CLAIMED", now=NOW + 1)),
    "frontier_reset": (frontier_reset, _SET.format(f=_F, hit="status = 'CLAIMED'", status="FRESH", now=NOW + 2)),
    "frontier_done": (frontier_done, _SET.format(f=_F, hit="status = 'CLAIMED'", status="DONE", now=NOW + 3)),
    "frontier_delete": (frontier_delete, f"WITH {_F} SELECT id, value, hops, status, timestamp FROM f WHERE status <> 'CLAIMED'"),
    "frontier_add": (frontier_add, f"WITH {_F}, {_N}, r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY hops, timestamp, id) AS k FROM n) SELECT id, value, hops, status, timestamp FROM r WHERE k = 1 AND value NOT IN (SELECT value FROM f)"),
    "frontier_in_flight": (frontier_in_flight, f"WITH {_F} SELECT id FROM f WHERE hops = 0 AND status = 'CLAIMED'"),
    "frontier_duplicates": (frontier_duplicates, f"WITH {_N} SELECT value AS id, count(*) AS n FROM n GROUP BY 1 HAVING count(*) > 1"),
    "remote_rows": (remote_rows, f"WITH {_F} SELECT id, repeat('L', hops::INT) AS path, value FROM f"),
    "queue_items": (queue_items, f"WITH {_F} SELECT id, CASE WHEN hops = 3 THEN 'Finished' ELSE 'Fresh' END AS status, 'Queue' AS source FROM f"),
    "seen_check": (seen_check, f"""WITH {TARGETS_SQL}, k AS (SELECT regexp_replace(url, '#.*$', '') AS url, max(CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END) AS r FROM pages GROUP BY 1),
        m AS (SELECT regexp_replace(target, '#.*$', '') AS url, CASE WHEN pos % 2 = 0 THEN 0 ELSE 1 END AS r, page_id, pos::BIGINT AS pos FROM targets UNION ALL SELECT regexp_replace(url, '#.*$', ''), 1, page_id, -1 FROM pages),
        b AS (SELECT m.*, greatest(k.r, max(m.r) OVER (PARTITION BY m.url ORDER BY page_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS past FROM m LEFT JOIN k USING (url))
        SELECT page_id, pos, url, CASE WHEN past IS NULL THEN 'keep' WHEN past = 0 AND r = 1 THEN 'promote' ELSE 'seen' END AS verdict FROM b"""),
    "seen_merge": (seen_merge, f"""WITH {TARGETS_SQL}, a AS (SELECT regexp_replace(url, '#.*$', '') AS url, 'asset' AS kind FROM pages UNION ALL SELECT regexp_replace(target, '#.*$', ''), CASE WHEN pos = 0 THEN 'seed' ELSE 'asset' END FROM targets)
        SELECT url, CASE WHEN {_RANK} = 1 THEN 'seed' ELSE 'asset' END AS kind FROM a GROUP BY url"""),
    "payload_dedupe": (payload_dedupe, "WITH d AS (SELECT doc_id, sha256(text) AS digest, strlen(text) AS size, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) SELECT doc_id, digest, CASE WHEN size >= 1024 AND first <> doc_id THEN first::VARCHAR END AS revisit_of FROM d"),
    "payload_totals": (payload_totals, "WITH d AS (SELECT strlen(text) AS size, strlen(text) >= 1024 AND min(doc_id) OVER (PARTITION BY text) <> doc_id AS late FROM documents) SELECT sum(size) FILTER (NOT late)::BIGINT AS written, coalesce(sum(size) FILTER (late), 0)::BIGINT AS saved, count(*) FILTER (late) AS revisits FROM d"),
    "rate_per_hour": (rate_per_hour, "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, count(*) AS n FROM events GROUP BY 1"),
    "rate_per_second_by_type": (rate_per_second_by_type, "SELECT epoch(date_trunc('second', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "totals_by_type": (totals_by_type, "SELECT event_type, count(*) AS total FROM events GROUP BY 1"),
    "glob_filtered": (glob_filtered, "SELECT count(*) AS n FROM events WHERE event_type LIKE '%i_k%'"),
    "status_classes": (status_classes, f"WITH {_E} SELECT " + ", ".join(f"count(*) FILTER (code // 100 = {d}) AS http_{d}xx" for d in (2, 3, 4, 5)) + " FROM e"),
    "mean_response": (mean_response, f"WITH {_E} SELECT event_type, coalesce(sum(ms) // count(ms), 0)::BIGINT AS mean_ms, sum(bytes)::BIGINT AS bytes FROM e GROUP BY 1"),
    "response_histogram": (response_histogram, f"WITH {_E}, b AS (SELECT 20.0::DOUBLE * pow(500.0::DOUBLE, i / 49.0::DOUBLE) AS le FROM range(50) t(i) UNION ALL SELECT NULL) SELECT round(le, 6) AS le, (SELECT count(*) FROM e WHERE b.le IS NULL OR ms + 0.5 <= b.le) AS n FROM b"),
    "metrics_snapshot": (metrics_snapshot, f"WITH {_E} SELECT count(*) AS urls_crawled, count(*) FILTER (event_id % 9 = 0) AS seeds_finished, " + ", ".join(f"count(*) FILTER (code // 100 = {d}) AS http_{d}xx" for d in (2, 3, 4, 5)) + ", count(*) FILTER (code = 429) AS cloudflare_challenges, 0::BIGINT AS akamai_challenges, (sum(ms) // count(ms))::BIGINT AS mean_response_ms, round(sum(bytes) / 1e9, 9) AS archived_gb FROM e"),
    "last_records": (last_records, "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 64"),
    "log_records": (log_records, "SELECT event_id, 'got \"it\" now' AS msg, event_type AS type, event_id % 11 = 0 AS duplicate FROM events WHERE event_id % 5 <> 0"),
    "list_rows": (list_rows, "SELECT page_id, url AS value FROM pages WHERE page_id % 5 NOT IN (0, 1)"),
}
