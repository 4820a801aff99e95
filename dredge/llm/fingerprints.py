"""Document fingerprints: SimHash in DataFrame functions, and search by permuted block tables.

Terms are pairs of neighbouring words (the last word stands alone), hashed to 128 bits; each
occurrence votes, so a term's weight is its frequency. A bit is set if more than half of the votes
for it are. Votes are counted by plain sums of packed longs, each with two 32-bit lanes, in one hash
aggregate on top of the exploded terms; the rows of a document lie in one task by then, so terms are
never shuffled, and a text of any length is one sum per lane.

`within` finds all pairs of fingerprints within a Hamming radius r: bits are cut into r + 2 blocks,
two fingerprints within r agree in at least two whole blocks, and for every choice of two blocks a
table keyed by them is joined. It works on distinct fingerprints and takes the queries to search for.

The next document is found in buckets of neighbouring ids (`_bucketed`), whose bounds follow the ids'
quantiles, so neither a far id nor an id that many rows share fills a bucket.

Null and empty texts have no terms: all bits are 0. Equal texts have equal fingerprints. Documents are
ordered by doc_id (null first), rows that repeat a doc_id by a hash of the text. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import combinations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dredge.llm.common import written

BITS, RADIUS = 128, 3
#: Documents of a bucket of neighbouring ids, on average; buckets of the level above; and ranges of ids,
#: found by their quantiles, in which buckets are of equal width. GROUPS * RANGES bounds are literals.
BUCKET, LEVEL, GROUPS, RANGES = 256, 4096, 32, 32
_LANES = 0x0000000100000001


def _bucketed(docs: DataFrame) -> DataFrame:
    """(b, doc_id, tie, text): buckets of neighbouring rows, in order of (doc_id, tie).

    tie is a hash of the text. Ids are cut at their quantiles into ranges of about as many rows. A range
    is cut into buckets of equal width; one that is a single id, or rows without id, by the tie instead.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_ranges = GROUPS * RANGES
    marks = [i / n_ranges for i in range(1, n_ranges)]
    found, n, no_id = rows.agg(F.percentile_approx("doc_id", marks, 4 * n_ranges), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    # Range i holds ids from bounds[i] to below bounds[i + 1]; a bound that comes twice is an id of many rows.
    counts = Counter(found or [])
    bounds = sorted(x for v, k in counts.items() for x in ({v, v + 1} if k > 1 else {v}) if x < 2**63)
    each = max(1, n // n_ranges)
    slots = max(1, each // BUCKET)
    groups = [bounds[i : i + RANGES] for i in range(0, len(bounds), RANGES)]
    longs = lambda v: F.array(*(F.lit(x).cast("long") for x in v)) if v else F.array().cast("array<long>")
    under = lambda v, x: F.size(F.filter(v, lambda e: e <= x))
    # Which group, then which bound in it: two short searches.
    g = under(longs([v[0] for v in groups]), F.col("doc_id"))
    inner = F.element_at(F.array(F.array().cast("array<long>"), *map(longs, groups)), g + 1)
    r = F.when(F.col("doc_id").isNull(), F.lit(None)).when(g == 0, 0).otherwise((g - 1) * RANGES + under(inner, F.col("doc_id")))
    lo, hi = [-(2**63), *bounds], [*bounds, 2**63]
    hot = {v: max(1, k * each // BUCKET) for v, k in counts.items() if k > 1}
    single = [hot.get(a, 0) if a + 1 == b else 0 for a, b in zip(lo, hi, strict=True)]
    # Ends of the outermost ranges are the ends of the ids. Doubles keep the order, which is all a slot needs.
    a, z = rows.agg(F.min("doc_id"), F.max("doc_id")).first() if bounds else (0, 0)
    lo, hi = [a or 0, *bounds], [*bounds, z or 0]
    at = lambda v, kind: F.element_at(F.array(*(F.lit(x).cast(kind) for x in v)), F.col("r") + 1)
    start, end = at(map(float, lo), "double"), at(map(float, hi), "double")
    slot = F.floor((F.col("doc_id").cast("double") - start) * slots / F.greatest(end - start, F.lit(1.0))).cast("long")
    by_tie = lambda k: F.floor((F.col("tie").cast("double") + 2.0**63) * k / 2.0**64).cast("long")
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("r", r)
    one = at(single, "long")
    within = F.when(F.col("doc_id").isNull(), by_tie(F.lit(max(1, no_id // BUCKET)))).when(one > 0, by_tie(one)).otherwise(F.least(slot, F.lit(slots).cast("long")))
    b = F.shiftleft(F.coalesce(F.col("r").cast("long") + 1, F.lit(0).cast("long")), 44) + within
    return rows.select(b.alias("b"), "doc_id", "tie", "text")


def _next_bucket(buckets: DataFrame) -> DataFrame:
    """(b, next) of each distinct bucket; after the last comes the first. Two levels, so that the one
    window without partitions sees a row per LEVEL buckets at most."""
    distinct = buckets.select("b").distinct().withColumn("s", F.floor(F.col("b") / LEVEL))
    inner = distinct.withColumn("n", F.lead("b").over(Window.partitionBy("s").orderBy("b")))
    top = distinct.groupBy("s").agg(F.min("b").alias("head"))
    w = Window.orderBy("s")
    top = top.select("s", F.coalesce(F.lead("head").over(w), F.min("head").over(Window.partitionBy())).alias("after"))
    return inner.join(top, "s").select("b", F.coalesce("n", "after").alias("next"))


def _with_next(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """rows (with b) plus rn, their place in the bucket, and next_<value>, of the row that follows."""
    w = Window.partitionBy("b").orderBy(*order)
    placed = rows.withColumn("rn", F.row_number().over(w)).withColumn("lead", F.lead(F.col(value)).over(w))
    heads = placed.where("rn = 1").select(F.col("b").alias("next"), F.col(value).alias("head"))
    follow = heads.join(_next_bucket(rows), "next").select("b", "head")
    return placed.join(follow, "b", "left").withColumn(f"next_{value}", F.coalesce("lead", "head")).drop("lead", "head")


def _edited(docs: DataFrame) -> DataFrame:
    """(b, rn, doc_id, text, n_chars, edited)."""
    rows = _with_next(_bucketed(docs), ["doc_id", "tie", "text"], "text").withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = (F.col("n_chars") - half).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), kept), F.substring("next_text", F.lit(1), half))
    return rows.select("b", "rn", "doc_id", "text", "n_chars", edited.alias("edited"))


def simhash(rows: DataFrame, keys: list[str], text: str, more: list[str] | None = None) -> DataFrame:
    """keys, more, and hi and lo, the 128 bits of the fingerprint (0 without terms).

    keys identify a row, more are further columns of it, longs all, as Spark sorts the terms for any other kind. If rows are partitioned by some of the keys no
    shuffle is needed.
    """
    more = more or []
    words = F.when(F.length(text) > 0, F.split(F.col(text), " "))
    hashed = rows.select(*keys, *more, words.alias("words"))
    hashed = hashed.select(*keys, *more, F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1))).alias("terms"))
    # Outer, for rows without terms; the plain form also makes Spark hash the terms again to filter on their size.
    term = hashed.select(*keys, *more, F.explode_outer("terms").alias("x")).withColumn("y", F.when(F.col("x").isNotNull(), F.xxhash64("x")))
    lanes = [F.sum(F.shiftright(c, j).bitwiseAND(F.lit(_LANES))).alias(f"{c}{j}") for c in ("x", "y") for j in range(32)]
    counted = term.groupBy(*keys).agg(F.count("x").alias("n"), *lanes, *(F.max(c).alias(c) for c in more))

    def bits(c: str) -> Column:
        low = [F.when((F.col(f"{c}{j}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2) > F.col("n"), F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j in range(32)]
        high = [F.when((F.shiftright(f"{c}{j}", 32) * 2) > F.col("n"), F.lit((1 << (j + 32)) - (1 << 64 if j == 31 else 0))).otherwise(F.lit(0)).cast("long") for j in range(32)]
        return reduce(lambda a, b: a.bitwiseOR(b), low + high)

    return counted.select(*keys, *more, bits("x").alias("hi"), bits("y").alias("lo"))


def _hex(hi: Column, lo: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.lower(F.concat(*(F.lpad(F.hex(F.coalesce(x, zero)), 16, "0") for x in (hi, lo))))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """1 - Hamming distance / bits."""
    zero = F.lit(0).cast("long")
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.coalesce(x, zero).bitwiseXOR(F.coalesce(y, zero))) for x, y in zip(a, b, strict=True)))
    return 1.0 - apart / F.lit(float(BITS))


def measure(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and n_within.

    n_within is the number of documents with a fingerprint within the radius of this document's, itself
    included, for the stated queries: every document whose id is divisible by 100; null for others.
    """
    versions = F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("edited").alias("t")))
    both = _edited(docs).select("b", "rn", "doc_id", "n_chars", F.explode(versions).alias("v")).select("b", "rn", "doc_id", "n_chars", "v.k", "v.t")
    # The digest of the edited text in four longs.
    digest = F.when(F.col("k") == 1, F.sha2(F.col("t").cast("binary"), 256))
    parts_of = [f"s{i}" for i in range(4)]
    both = both.withColumn("sha", digest).select("*", *(F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("long").alias(x) for i, x in enumerate(parts_of))).drop("sha")
    prints = written(simhash(both, ["b", "rn", "k"], "t", ["doc_id", "n_chars", *parts_of]), "fingerprints")
    own = prints.where("k = 0").select("b", F.col("rn").alias("at"), "doc_id", "n_chars", F.struct("hi", "lo").alias("own"))
    edited = prints.where("k = 1").select("b", F.col("rn").alias("at"), F.lower(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in parts_of))).alias("edited_sha256"), F.struct("hi", "lo").alias("ed"))
    known = prints.where("k = 0").groupBy("hi", "lo").agg(F.count("*").alias("documents"))
    queries = prints.where("k = 0 and doc_id % 100 = 0").select("hi", "lo").distinct()
    found = within(known, queries, radius).join(known, ["hi", "lo"]).groupBy("q_hi", "q_lo").agg(F.sum("documents").alias("n_within"))
    found = written(found.select(F.struct(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).alias("own"), "n_within"), "found")
    rows = _with_next(own.join(edited, ["b", "at"]), ["at"], "own").join(found, "own", "left")
    parts = lambda c: (F.col(f"{c}.hi"), F.col(f"{c}.lo"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", _hex(*parts("own")).alias("fingerprint"), _hex(*parts("ed")).alias("edited_fingerprint"),
        likeness(parts("own"), parts("ed")).alias("near_edited"), likeness(parts("own"), parts("next_own")).alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.col("n_within")).alias("n_within"),
    )


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hi, lo) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return simhash(rows, ["row"], "text", ["doc_id"]).drop("row")


def brute(text: str | None) -> int:
    """The 128 bits of a text by counting votes one by one, for tests."""
    words, votes = (text or "").split(" ") if text else [], [0] * 128
    for i, w in enumerate(words):
        x = xxhash.xxh64_intdigest(w.encode(), 42)
        if i + 1 < len(words):
            x = xxhash.xxh64_intdigest(words[i + 1].encode(), x)
        y = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42)
        for j in range(128):
            votes[j] += 1 if ((x << 64) | y) >> j & 1 else -1
    return sum(1 << j for j, v in enumerate(votes) if v > 0)


def _cut(hi: Column, lo: Column, a: int, b: int) -> Column:
    """Bits a to b of the 128 as a long; bit 0 is the lowest of lo."""
    mask = F.lit((1 << (b - a)) - 1 if b - a < 64 else -1).cast("long")
    if b <= 64:
        return F.shiftrightunsigned(lo, a).bitwiseAND(mask)
    if a >= 64:
        return F.shiftrightunsigned(hi, a - 64).bitwiseAND(mask)
    low = F.shiftrightunsigned(lo, a)
    return F.shiftleft(hi.bitwiseAND(F.lit((1 << (b - 64)) - 1)), 64 - a).bitwiseOR(low)


def tables(prints: DataFrame, radius: int) -> DataFrame:
    """A row per fingerprint and choice of two of radius + 2 blocks: (hi, lo, which, k1, k2)."""
    edges = [BITS * i // (radius + 2) for i in range(radius + 3)]
    cut = [_cut(F.col("hi"), F.col("lo"), a, b) for a, b in zip(edges, edges[1:], strict=False)]
    keys = [F.struct(F.lit(n).alias("which"), cut[i].alias("k1"), cut[j].alias("k2")) for n, (i, j) in enumerate(combinations(range(radius + 2), 2))]
    return prints.select("hi", "lo", F.explode(F.array(*keys)).alias("t")).select("hi", "lo", "t.which", "t.k1", "t.k2")


def within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of distinct fingerprints (hi, lo, q_hi, q_lo, distance) with a query's within the radius.

    prints, queries: columns hi and lo. Rows with the same fingerprint are one here; join on hi and lo
    to go back to documents.
    """
    mine = tables(prints.select("hi", "lo").distinct(), radius)
    theirs = tables(queries.select("hi", "lo").distinct(), radius).withColumnsRenamed({"hi": "q_hi", "lo": "q_lo"})
    far = F.bit_count(F.col("hi").bitwiseXOR(F.col("q_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("q_lo")))
    found = mine.join(theirs, ["which", "k1", "k2"]).withColumn("distance", far).where(F.col("distance") <= radius)
    return found.select("hi", "lo", "q_hi", "q_lo", "distance").distinct()
