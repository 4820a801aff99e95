"""The crawl frontier as a table: add, pick, claim, reset, done, delete, and its invariants.

Every function takes and returns DataFrames with the columns of `schemas.FRONTIER`; storing them is
the caller's business. `now` is a parameter, so that results are reproducible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dredge.functions import columns as C


def add(frontier: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows to append: of each new value the one with the fewest hops; values that are queued are skipped."""
    first = rows.groupBy("value").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "value"]), F.struct("hops", "timestamp", "id")).alias("r"))
    flat = first.select("value", "r.*").select(rows.columns)
    return flat.join(frontier.select("value"), "value", "left_anti").select(rows.columns)


def pick(frontier: DataFrame, n: int) -> DataFrame:
    """The n fresh rows with the fewest hops, then the oldest, then the least id."""
    return frontier.where("status = 'FRESH'").orderBy("hops", "timestamp", "id").limit(n)


def _set(frontier: DataFrame, ids: DataFrame, status: str, now: int) -> DataFrame:
    marked = frontier.join(ids.select("id").distinct().withColumn("__m", F.lit(True)), "id", "left")
    hit = F.col("__m").isNotNull()
    return marked.select(*[F.when(hit, F.lit(status)).otherwise(F.col(c)).alias(c) if c == "status" else F.when(hit, F.lit(now).cast("long")).otherwise(F.col(c)).alias(c) if c == "timestamp" else F.col(c) for c in frontier.columns])


def absent(frontier: DataFrame, ids: DataFrame) -> DataFrame:
    """Must be empty: ids that an answer names and the queue doesn't have."""
    return ids.select("id").distinct().join(frontier.select("id"), "id", "left_anti")


def claim(frontier: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    return _set(frontier, ids, "CLAIMED", now)


def reset(frontier: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """In-flight rows go back to FRESH, as on shutdown."""
    return _set(frontier, ids, "FRESH", now)


def done(frontier: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    return _set(frontier, ids, "DONE", now)


def delete(frontier: DataFrame, ids: DataFrame) -> DataFrame:
    """Finished rows leave the queue; what was crawled is known to the seen-set."""
    return frontier.join(ids.select("id"), "id", "left_anti")


def duplicate_ids(batch: DataFrame) -> DataFrame:
    """Must be empty: ids that a batch has twice."""
    return batch.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def already_in_flight(batch: DataFrame, frontier: DataFrame) -> DataFrame:
    """Must be empty: rows of a batch that are claimed already."""
    return batch.join(frontier.where("status = 'CLAIMED'").select("id"), "id", "left_semi")


def in_flight(frontier: DataFrame) -> DataFrame:
    return frontier.where("status = 'CLAIMED'")


def split_batches(rows: DataFrame, batch: int, concurrency: int) -> DataFrame:
    """Rows numbered into `concurrency` requests of batch // concurrency rows each; the remainder is left out."""
    size = batch // concurrency if concurrency else batch
    w = Window.orderBy("hops", "timestamp", "id")
    picked = pick(rows, size * concurrency)
    return picked.withColumn("request", F.floor((F.row_number().over(w) - 1) / F.lit(size)).cast("int"))


def to_remote(rows: DataFrame) -> DataFrame:
    """Queue rows with hops coded as a path of L."""
    return rows.withColumn("path", C.encode_hops(F.col("hops")))


def from_remote(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hops", C.decode_hops(F.col("path"))).drop("path")


def to_items(rows: DataFrame, source: str = "Queue") -> tuple[DataFrame, DataFrame]:
    """(items, unparsable rows): queue rows as seeds; rows whose value is no URL go straight to the end."""
    ok = F.col("value").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]|^/")
    items = rows.where(ok).select(
        F.col("id").alias("item_id"), F.col("id").alias("seed_id"), F.lit(None).cast("string").alias("parent_id"), F.col("value").alias("url"),
        F.col("via").alias("seed_via"), F.lit("Fresh").alias("status"), F.lit(source).alias("source"), F.col("hops").cast("int").alias("hops"), F.lit(0).alias("redirects"),
    )
    return items, rows.where(~ok)
