"""Archiving of captures: payload dedupe, and rows for the archive sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dredge.operators.store import written


def revisits(captures: DataFrame, order: list[str], min_size: int = 1024, body: str = "body") -> DataFrame:
    """captures plus digest and revisit_of: the url of the first capture with the same payload, if it isn't this one.

    Payloads under min_size are always written. The first capture per digest is a native minimum,
    so a payload that a third of all captures share is one row before the join. Captures that come with
    digest and size need no body.
    """
    keyed = captures
    if not {"digest", "size"} <= set(captures.columns):
        keyed = captures.withColumn("digest", F.sha2(F.col(body).cast("binary"), 256)).withColumn("size", F.octet_length(F.col(body)))
    first = keyed.where(F.col("size") >= min_size).groupBy("digest").agg(F.min(F.struct(*order, F.col("url").alias("__url"))).alias("f"))
    joined = keyed.join(written(first, "first-payloads"), "digest", "left")
    same = joined["f.__url"] == joined["url"]
    for c in order:
        same = same & (joined[f"f.{c}"] == joined[c])
    late = joined["f"].isNotNull() & (joined["size"] >= min_size) & ~same
    return joined.withColumn("revisit_of", F.when(late, F.col("f.__url"))).drop("f")


def totals(deduped: DataFrame) -> DataFrame:
    """Bytes written and bytes and captures saved."""
    late = F.col("revisit_of").isNotNull()
    return deduped.agg(F.sum(F.when(~late, F.col("size"))).alias("written"), F.coalesce(F.sum(F.when(late, F.col("size"))), F.lit(0)).alias("saved"), F.count_if(late).alias("revisits"))
