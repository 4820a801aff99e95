"""Schemas and state names of the crawl tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: States of an item, in their order, and sources of an item.
STATES = ("Fresh", "PreProcessed", "Archived", "Failed", "Completed", "Seen", "GotRedirected", "GotChildren")
SOURCES = ("Insert", "Queue", "HQ", "Postprocess", "Feedback")
#: States in which an item needs nothing more.
FINAL = ("Completed", "Seen", "Failed")
#: States of a frontier row.
QUEUE_STATES = ("FRESH", "CLAIMED", "DONE")

FRONTIER = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("value", T.StringType(), False),
        T.StructField("via", T.StringType()),
        T.StructField("hops", T.IntegerType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("timestamp", T.LongType(), False),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("url", T.StringType(), False),
        T.StructField("status", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body", T.BinaryType()),
    ]
)

ITEMS = T.StructType(
    [
        T.StructField("item_id", T.StringType(), False),
        T.StructField("seed_id", T.StringType(), False),
        T.StructField("parent_id", T.StringType()),
        T.StructField("url", T.StringType(), False),
        T.StructField("seed_via", T.StringType()),
        T.StructField("status", T.StringType(), False),
        T.StructField("source", T.StringType()),
        T.StructField("hops", T.IntegerType()),
        T.StructField("redirects", T.IntegerType()),
    ]
)

LINKS = "array<struct<url:string,kind:string,tag:string>>"
