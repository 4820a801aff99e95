"""Crawl metrics as aggregates over a table of fetch events, and their text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dredge.functions import columns as C

#: Histogram bounds run from 20 ms to 10 s in 50 exponential steps.
FIRST_MS, LAST_MS, STEPS = 20.0, 10_000.0, 50


def counter(deltas: Column) -> Column:
    return F.coalesce(F.sum(deltas), F.lit(0))


def mean(values: Column) -> Column:
    """Integer mean, 0 of nothing."""
    return F.coalesce(F.floor(F.sum(values) / F.count(values)), F.lit(0)).cast("long")


def rate(events: DataFrame, ts: str, *keys: str, every: str = "1 second") -> DataFrame:
    """Events per tumbling window and key."""
    return events.groupBy(F.window(ts, every)["start"].alias("start"), *keys).agg(F.count("*").alias("n"))


def totals(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("total"))


def filtered_sum(events: DataFrame, key: str, pattern: str) -> DataFrame:
    """Events whose key matches a glob."""
    return events.where(C.glob(F.col(key), pattern)).agg(F.count("*").alias("n"))


def status_classes(events: DataFrame, code: str = "code") -> DataFrame:
    c = F.col(code).cast("string")
    return events.agg(*[F.count_if(c.startswith(str(d))).alias(f"http_{d}xx") for d in (2, 3, 4, 5)])


def histogram_bounds() -> list[float]:
    factor = (LAST_MS / FIRST_MS) ** (1 / (STEPS - 1))
    return [FIRST_MS * factor**i for i in range(STEPS)]


def histogram(events: DataFrame, ms: str) -> DataFrame:
    """(le, n): events up to each bound, and all under infinity. One row per bound comes from one pass."""
    bounds = histogram_bounds()
    value = F.col(ms)
    place = F.when(value <= bounds[0], 0).otherwise(F.least(F.lit(STEPS), F.ceil((F.log(value) - F.lit(0.0) - F.log(F.lit(FIRST_MS))) / F.log(F.lit(bounds[1] / bounds[0])))))
    single = events.where(value.isNotNull()).groupBy(place.cast("int").alias("place")).agg(F.count("*").alias("k"))
    grid = events.sparkSession.createDataFrame([(i, b) for i, b in enumerate([*bounds, float("inf")])], "place int, le double")
    joined = grid.join(single.withColumnRenamed("place", "at"), F.col("at") <= F.col("place"), "left")
    return joined.groupBy("le").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))


#: Columns that a fetch event may have beyond those of `snapshot`, with the counter each one gives.
_OPTIONAL = {
    "finished_seed": "finished_seeds", "pre_busy": "preprocessor_routines", "archive_busy": "archiver_routines", "post_busy": "postprocessor_routines", "finish_busy": "finisher_routines", "paused": "paused",
    "remote_asset_saved": "seencheck_assets", "seen_error": "seencheck_failures", "queue_error": "queue_failures",
}


def snapshot(events: DataFrame) -> DataFrame:
    """One row with the counters of a crawl. events: code, ms, bytes, seed_done, challenge ('cloudflare', 'akamai' or null).

    Where events have them also: fetched_at (URLs a second over the span of the crawl), body_ms and process_ms (mean
    times), written, dedupe_local and dedupe_remote (bytes and records written, and saved by the local and the
    remote index), and the flags of _OPTIONAL, which are counted.
    """
    c, have = F.col("code").cast("string"), set(events.columns)
    more = [F.count_if(F.col(x)).alias(name) for x, name in _OPTIONAL.items() if x in have]
    if "fetched_at" in have:
        span = F.unix_seconds(F.max("fetched_at").cast("timestamp")) - F.unix_seconds(F.min("fetched_at").cast("timestamp")) + 1
        more.append(F.coalesce(F.floor(F.count("*") / span), F.lit(0)).cast("long").alias("urls_per_second"))
    more += [mean(F.col(x)).alias(f"mean_{x}") for x in ("body_ms", "process_ms") if x in have]
    for x in ("written", "dedupe_local", "dedupe_remote"):
        if x in have:
            more += [counter(F.col(x)).alias(f"{x}_bytes"), F.count_if(F.col(x) > 0).alias(f"{x}_records")]
    return events.agg(
        F.count("*").alias("urls_crawled"),
        F.count_if("seed_done").alias("seeds_finished"),
        *[F.count_if(c.startswith(str(d))).alias(f"http_{d}xx") for d in (2, 3, 4, 5)],
        F.count_if(F.col("challenge") == "cloudflare").alias("cloudflare_challenges"),
        F.count_if(F.col("challenge") == "akamai").alias("akamai_challenges"),
        mean(F.col("ms")).alias("mean_response_ms"),
        (F.coalesce(F.sum("bytes"), F.lit(0)) / F.lit(1e9)).alias("archived_gb"),
        *more,
    )


def children_captured(items: DataFrame) -> DataFrame:
    """Captured children per seed."""
    kid = F.col("parent_id").isNotNull() & F.col("status").isin("Archived", "Completed", "GotChildren", "GotRedirected")
    return items.groupBy("seed_id").agg(F.count_if(kid).alias("children"))


def exposition(snapshot_row: dict, prefix: str, labels: dict[str, str], counters: tuple[str, ...] = (), histograms: dict[str, list[tuple[float, int]]] | None = None) -> str:
    """Metrics as text: one gauge per column of a snapshot, or a counter if it is named as one, and histograms.

    A histogram is the rows (le, n) of `histogram`, whose counts are cumulative.
    """
    tags = [f'{k}="{v}"' for k, v in labels.items()]
    lines = []
    for name, value in snapshot_row.items():
        kind = "counter" if name in counters else "gauge"
        lines += [f"# TYPE {prefix}{name} {kind}", f"{prefix}{name}{{{','.join(tags)}}} {value}"]
    for name, rows in (histograms or {}).items():
        lines.append(f"# TYPE {prefix}{name} histogram")
        bound = lambda le: "+Inf" if le == float("inf") else repr(round(le, 6))
        ordered = sorted(rows)
        lines += [f"{prefix}{name}_bucket{{{','.join([*tags, f'le={chr(34)}{bound(le)}{chr(34)}'])}}} {n}" for le, n in ordered]
        lines.append(f"{prefix}{name}_count{{{','.join(tags)}}} {ordered[-1][1] if ordered else 0}")
    return "\n".join(lines) + "\n"


def last_n(logs: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The newest n records, newest last: what an overwriting ring buffer holds."""
    return logs.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def least_used(buckets: DataFrame) -> DataFrame:
    """The host that a full bucket manager would evict."""
    return buckets.agg(F.min_by("host", F.struct("uses", "host")).alias("host"))
