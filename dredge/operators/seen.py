"""The seen-set: URLs met before, as assets or as seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dredge.operators.store import written


def url_key(url: Column) -> Column:
    """Key for partition pruning; equality is always of the URL itself."""
    return F.xxhash64(url)


def check(urls: DataFrame, seen: DataFrame, order: list[str]) -> DataFrame:
    """urls (url, kind, ...) plus `verdict`: keep, promote or seen.

    A URL not seen is kept; one seen as an asset that now is a seed is promoted and kept; others are
    seen. Within a batch rows count in the given order, which tells the rows of a URL apart, so only the
    first of a URL is new, and an asset may still be followed by its promotion.

    What a row has before it follows from two native minima per URL, of all its rows and of its seeds, so a
    link that every page carries is one row before the join.
    """
    known = seen.groupBy("url").agg(F.max(F.when(F.col("kind") == "seed", 1).otherwise(0)).alias("__rank"))
    here = F.struct(*order)
    mine = F.when(F.col("kind") == "seed", 1).otherwise(0)
    first = urls.groupBy("url").agg(F.min(here).alias("__any"), F.min(F.when(mine == 1, here)).alias("__seed"))
    joined = urls.join(written(first.join(known, "url", "left"), "first-seen"), "url")
    before = F.when(F.col("__seed") < here, 1).when(F.col("__any") < here, 0)
    past = F.greatest(F.col("__rank"), before)
    verdict = F.when(past.isNull(), "keep").when((past == 0) & (mine == 1), "promote").otherwise("seen")
    return joined.withColumn("verdict", verdict).drop("__rank", "__any", "__seed")


def updates(checked: DataFrame) -> DataFrame:
    """Rows to merge into the seen-set: the strongest kind per new or promoted URL."""
    rank = F.max(F.when(F.col("kind") == "seed", 1).otherwise(0))
    return checked.where("verdict <> 'seen'").groupBy("url").agg(F.when(rank == 1, "seed").otherwise("asset").alias("kind"))


def merge(seen: DataFrame, new: DataFrame) -> DataFrame:
    """The seen-set with the new rows; a seed replaces an asset."""
    rank = F.max(F.when(F.col("kind") == "seed", 1).otherwise(0))
    return seen.select("url", "kind").unionByName(new.select("url", "kind")).groupBy("url").agg(F.when(rank == 1, "seed").otherwise("asset").alias("kind"))


def remote_check(items: DataFrame, remote: DataFrame) -> DataFrame:
    """Fresh children that a remote set has are Seen; seeds are never asked for."""
    child = F.col("parent_id").isNotNull() & (F.col("status") == "Fresh")
    marked = items.join(remote.select("url").distinct().withColumn("__m", F.lit(True)), "url", "left")
    return marked.withColumn("status", F.when(child & F.col("__m").isNotNull(), "Seen").otherwise(F.col("status"))).drop("__m").select(items.columns)


def failed_check(items: DataFrame) -> DataFrame:
    """What becomes of a seed's tree when the check can't be made: the seed and all Fresh items fail."""
    hit = F.col("parent_id").isNull() | (F.col("status") == "Fresh")
    return items.withColumn("status", F.when(hit, "Failed").otherwise(F.col("status")))
