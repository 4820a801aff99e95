"""Splits and bounded samples of labelled rows, for the operators that fit a model."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that are never learned from: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(docs: DataFrame, labels: DataFrame, rows: int, byte_limit: int) -> list[tuple[str, object]]:
    """(text, label) of at most `rows` labelled documents and `byte_limit` bytes, in order of a hash of doc_id.

    labels: doc_id and label, one row per doc_id, rows to learn from only. The sample is taken by id
    before any text moves; of a doc_id with several texts the shortest is taken. Each label has an equal
    share of the bytes; what is left of the shares goes to the other texts. A text that exceeds the bytes
    left is skipped; only of a label that would have none is the shortest taken, however long. So at most
    `rows` ids and `byte_limit` bytes, or one text per label, come to the driver.
    """
    draw = F.xxhash64("doc_id", F.lit(7))
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("size"))
    known = known.join(labels, "doc_id").groupBy("doc_id").agg(F.min("size").alias("size"), F.first("label").alias("label"))
    chosen = known.orderBy(draw, "doc_id").limit(rows).collect()
    drawn = {r["doc_id"]: (r["label"], r["size"]) for r in chosen}
    every = {label for label, _ in drawn.values()}
    ids, left, spent = {}, byte_limit, Counter()
    for own in (True, False):
        for i, (label, size) in drawn.items():
            if i not in ids and size <= (byte_limit // len(every) - spent[label] if own else left):
                ids[i], left = label, left - size
                spent[label] += size
    for label in every - set(spent):
        ids[min((i for i in drawn if drawn[i][0] == label), key=lambda i: drawn[i][1])] = label
    if not ids:
        return []
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i, drawn[i][1]) for i in ids], "doc_id long, size int")
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("size"), "text")
    found = texts.join(F.broadcast(wanted), ["doc_id", "size"]).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return [(r["text"], ids[r["doc_id"]]) for r in sorted(found, key=lambda r: r["doc_id"])]
