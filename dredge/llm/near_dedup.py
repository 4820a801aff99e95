"""MinHash near-dedup with odd sketches, exact links and connected components.

A document's set is its distinct shingles of `k` neighbouring words (the whole sequence if there are
fewer), ASCII letters in lower case. Two documents are linked if 100 * intersection >= percent * union.

1.  One pass gives each document its set's size and digest, BANDS bands of ROWS minima, and the odd
    sketch: the parity bitmap of BINS further MinHash samples, one per bin of the hash range.
    Documents with equal sets are one class from here on, stood for by the smallest doc_id; copies of
    any number are one row.
2.  A band bucket is represented by its smallest document, and every document is compared with one
    representative of its buckets, so a bucket of any size makes at most one candidate per member.
    The XOR population count of two odd sketches estimates how far the samples differ; pairs that
    may be linked are confirmed on the full sets. Texts are shuffled for that only if a filter of the
    pairs' documents lets them through; it has no false negatives.
3.  Confirmed links are joined to components. Buckets whose members are all in one component need
    nothing more. In one of at most SMALL members the pairs in different components are candidates. A
    larger one is refined by a pivot, the member that shares most buckets with most others: every member
    is compared with it on the full sets, and what a member has more and less than the pivot, its
    deviations, tells whether two members can be linked. Two that aren't both linked with the pivot must
    share so many deviations that they share one among the first few of each (`_deviations`), and these
    few are the keys of new, smaller buckets without the pivot. A second pivot separates variants of a
    text; a third would no longer be near the middle of its bucket, so what is left then, members at the
    threshold that share a rare deviation, are candidates by their sketches and bounds. So every pair that
    shares a band is compared, ruled out exactly or already connected, and no band's bucket is expanded.

A pair of similarity 0.8 shares no band once in 10**7; its sketches are allowed SIGMAS standard
deviations from what they are expected to show at the threshold.

Null text and text without words have empty sets: linked with nothing. Rows that repeat a doc_id are
one node with the links of all its texts. Rows without doc_id have no component and are kept. Extra
columns are ignored by `measure` and kept by `dedup`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dredge.llm import kernel as K
from dredge.llm.common import arrow_map, int64, signed, written

BANDS, ROWS, BINS, SKETCH_BITS = 32, 4, 1024, 1024
SIGMAS = 6.0
#: Members of a bucket whose pairs are candidates; beyond, a pivot refines it, at most so many times.
SMALL, LEVELS = 64, 2
#: Sides of a bucket's members: pairs are made within BOTH, and between ONE and OTHER.
BOTH, ONE, OTHER = 1, 2, 4
#: Longs of the filter that texts pass before a shuffle, at most: some 40 MB as a broadcast table. A document sets
#: two bits of one long; with more than 4 documents a long the filter lets through more texts, and never fewer.
FILTER_LONGS = 1 << 20
_NO_CAP = 1 << 62

_rng = np.random.Generator(np.random.PCG64(77))
_MULTIPLIERS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SALTS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_WORDS = [f"s{i}" for i in range(SKETCH_BITS // 64)]


def shingles(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, by row."""
    starts, ends, words = K.word_spans(buf, offs, K.SPACES)
    values = K.word_hashes(K.lowered(buf), starts, ends)
    size = np.diff(words)
    n = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(len(size)), n)
    at = words[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
    sums = K.prefix_sums(values)
    full = K.span_hash(sums, at, np.minimum(at + k, words[row + 1]))
    order = np.argsort(full ^ K.mix(row.astype(np.uint64)))
    # Equal keys are equal (row, hash) pairs; the first of each stays.
    tagged = (full ^ K.mix(row.astype(np.uint64)))[order]
    keep = np.sort(order[np.append(True, tagged[1:] != tagged[:-1])]) if len(order) else order
    return row[keep], full[keep]


_SIGNED = "doc long, n long, d1 long, d2 long, o long, " + ", ".join(f"{w} long" for w in _WORDS) + ", bands array<long>"


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Size, digest, odd sketch and band hashes of every row; rows with empty sets have null bands."""
    names = [x.split()[0] for x in _SIGNED.split(", ")]

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0)
        buf, offs = K.column_bytes(batch.column(1))
        for a, b in K.blocks(offs):
            row, full = shingles(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k)
            n = np.bincount(row, minlength=b - a)
            have = np.flatnonzero(n)
            head = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
            out = np.zeros((3 + len(_WORDS), b - a), np.uint64)
            bands = pa.nulls(b - a, pa.list_(pa.int64()))
            if len(have):
                out[0, have] = np.add.reduceat(K.mix(full), head)
                out[1, have] = np.add.reduceat(K.mix(full ^ _SALTS[0]), head)
                least = np.empty((BANDS * ROWS, len(have)), np.uint64)
                for i, m in enumerate(_MULTIPLIERS):
                    least[i] = np.minimum.reduceat(full * m, head)
                least = K.mix(least ^ _SALTS[:, None])
                # One sample per bin: the least hash that falls into it. Rows are worked off a few at a time.
                drawn = K.mix(full ^ _SALTS[1])
                place = np.repeat(np.arange(len(have)), np.diff(np.append(head, len(row)))) * BINS + (drawn >> np.uint64(54)).astype(np.int64)
                samples = np.full(len(have) * BINS, ~np.uint64(0))
                np.minimum.at(samples, place, drawn)
                used = np.flatnonzero(samples != ~np.uint64(0))
                out[2, have] = np.bincount(used // BINS, minlength=len(have)).astype(np.uint64)
                bit = (K.mix(samples[used] ^ _SALTS[2]) % np.uint64(SKETCH_BITS)).astype(np.int64) + used // BINS * SKETCH_BITS
                odd = (np.bincount(bit, minlength=len(have) * SKETCH_BITS) & 1).astype(np.uint8)
                out[3:, have] = np.packbits(odd.reshape(len(have), -1), axis=1).view(np.uint64).T
                band = least.reshape(BANDS, ROWS, len(have))
                hashed = K.mix(reduce(lambda x, r: K.mix(x) + band[:, r], range(1, ROWS), band[:, 0]) + np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))
                places = np.full(b - a + 1, 0, np.int32)
                places[1:] = np.cumsum(n > 0) * BANDS
                flat = pa.array(signed(np.ascontiguousarray(hashed.T)).ravel())
                bands = pa.ListArray.from_arrays(pa.array(places, pa.int32()), flat, mask=pa.array(n == 0))
            cols = [ids.slice(a, b - a).cast(pa.int64()), pa.array(n), *(pa.array(signed(x)) for x in out), bands]
            yield pa.RecordBatch.from_arrays(cols, names)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), step, _SIGNED)


def _apart(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in _WORDS))


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sketches allow a similarity of `percent`. Columns: {side}n set size, {side}o samples, {side}s0...

    The parity bits apart tell the size of the samples' difference. At the threshold j the sets'
    union of (na + nb) / (1 + j) shingles fills a number of bins whose mean and variance are known, of
    which a share j agrees, so the expected difference is known too; the bits apart may exceed what it
    gives by SIGMAS standard deviations of sampling, of the filled bins and of the parity bits together.
    """
    bits, bins, j = float(SKETCH_BITS), float(BINS), percent / 100
    na, nb, oa, ob = (F.col(f"{s}{x}").cast("double") for x in "no" for s in (a, b))
    load = (na + nb) / F.lit((1 + j) * bins)
    filled = bins * (1 - F.exp(-load))
    expected = F.greatest(oa + ob - 2 * j * filled, F.lit(0.0))
    # Variance of the parity bits for a difference of that size; of the samples, which shrinks as the bins
    # come to hold the whole sets; and of the number of filled bins.
    x = 4 * expected / F.lit(bits)
    parity = F.lit(bits / 4) * (1 - F.exp(-x) * (1 + x))
    sampling = 4 * j * (1 - j) * filled * (1 - filled / (load * bins))
    occupancy = 4 * j * j * bins * (F.exp(-load) - (1 + load) * F.exp(-2 * load))
    # In bits, not carried back through the logarithm: that would skew the upper tail.
    deviation = F.sqrt(parity + (sampling + occupancy + 4) * F.exp(-x))
    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return sizes & (_apart(a, b) <= F.lit(bits / 2) * (1 - F.exp(-x / 2)) + SIGMAS * deviation)


def _sketch(sigs: DataFrame, side: str, *more: str) -> DataFrame:
    return sigs.select(F.col("doc").alias(side), *(F.col(w).alias(f"{side}{w}") for w in ("n", "o", *_WORDS, *more)))


def _estimated(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches allow a link."""
    both = pairs.join(_sketch(sigs, "a"), "a").join(_sketch(sigs, "b"), "b")
    return both.where(may_link("a", "b", percent)).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked, on their full sets. texts: (doc, text)."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = int64(batch.column(0)), int64(batch.column(1))
        (bufa, offa), (bufb, offb) = (K.column_bytes(batch.column(i)) for i in (2, 3))
        for x, y in K.blocks(offa + offb):
            ra, ha = shingles(bufa[offa[x] : offa[y]], offa[x : y + 1] - offa[x], k)
            rb, hb = shingles(bufb[offb[x] : offb[y]], offb[x : y + 1] - offb[x], k)
            row = np.concatenate([ra, rb])
            key = np.concatenate([ha, hb]) ^ K.mix(row.astype(np.uint64))
            order = np.argsort(key)
            twice = np.flatnonzero(key[order][1:] == key[order][:-1])
            both = np.bincount(row[order[twice]], minlength=y - x)
            union = np.bincount(row, minlength=y - x) - both
            ok = (100 * both >= percent * union) & (union > 0)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[x:y][ok]), pa.array(b[x:y][ok])], ["a", "b"])

    return arrow_map(_compared(pairs, texts), step, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc, comp) of all linked documents; comp is the smallest doc reachable.

    Each round takes the least label among the neighbours and then the label's own label; rounds
    follow the logarithm of the longest path, and each ends in a written table.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc"), F.least("a", "m").alias("comp")), "labels")
    while True:
        around = both.join(labels.select(F.col("doc").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        nearer = labels.join(around.withColumnRenamed("a", "doc"), "doc").select("doc", F.least("comp", "m").alias("next"), F.col("comp").alias("old"))
        jump = labels.select(F.col("doc").alias("next"), F.col("comp").alias("far"))
        moved = written(nearer.join(jump, "next", "left").select("doc", F.least("next", F.coalesce("far", "next")).alias("comp"), "old"), "labels")
        labels = moved.select("doc", "comp")
        if moved.where("comp <> old").isEmpty():
            return labels


def _needed(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Texts of the documents of pairs (a, b), a written table, and a few others; nothing of the texts is shuffled."""
    longs = min(FILTER_LONGS, 1 << (pairs.count() // 2).bit_length())
    place = F.xxhash64("doc").bitwiseAND(longs - 1)
    bits = F.expr("shiftleft(1L, cast(shiftright(xxhash64(doc), 40) & 63 as int)) | shiftleft(1L, cast(shiftright(xxhash64(doc), 50) & 63 as int))")
    docs = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
    known = written(docs.groupBy(place.alias("place")).agg(F.bit_or(bits).alias("bits")), "filter")
    held = texts.withColumn("place", place).join(F.broadcast(known), "place")
    return held.where(F.col("bits").bitwiseAND(bits) == bits).select(texts.columns)


def _compared(pairs: DataFrame, texts: DataFrame, *more: str) -> DataFrame:
    """Pairs (a, b), a written table, with both texts, ta and tb, and more columns. texts: (doc, text)."""
    texts = _needed(texts, pairs)
    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb", *more)


_DEVIATIONS = "a long, b long, h long, side int, excess long, cap long"


def _deviations(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Keys (h) by which members (a) of a bucket with pivot b can still be linked; side 0: a and b are linked.

    pairs: (a, b, sides). Let a member have e shingles more and m fewer than the pivot of size n, and two
    members have o of these deviations in common. Then they are linked if and only if
        (100 + percent) o >= A + A' - (100 - percent) n,  A = percent e + 100 m.
    A member is near, that is linked with the pivot, if its excess A - (100 - percent) n isn't positive.
    With a far one of excess D, o >= (A' + D) / (100 + percent) for any other, and as A' >= percent o, also
    o >= D / 100, which a near one can only have if percent D <= 100 (100 - percent) n. Deviations are put in one order, shingles more (rare ones) before shingles fewer; two
    linked members have one in common among the first d - o + 1 of each one's d. As at place i at most
    d - i are left to have in common, D must not exceed the cap (100 + percent) (d - i) - A'.

    Far members meet one another by short lists of both, and near ones by a long list of their own.
    """
    names = [x.split()[0] for x in _DEVIATIONS.split(", ")]
    least = math.gcd(100, percent)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b, sides = (int64(batch.column(i)) for i in (0, 1, 4))
        (bufa, offa), (bufb, offb) = (K.column_bytes(batch.column(i)) for i in (2, 3))
        for x, y in K.blocks(offa + offb):
            ra, ha = shingles(bufa[offa[x] : offa[y]], offa[x : y + 1] - offa[x], k)
            rb, hb = shingles(bufb[offb[x] : offb[y]], offb[x : y + 1] - offb[x], k)
            row, full, fewer = np.concatenate([ra, rb]), np.concatenate([ha, hb]), np.repeat([False, True], [len(ra), len(rb)])
            key = full ^ K.mix(row.astype(np.uint64))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            alone = order[~(np.append(same, False) | np.append(False, same))] if len(order) else order
            alone = alone[np.lexsort((full[alone], fewer[alone], row[alone]))]
            n = np.bincount(rb, minlength=y - x)
            more, less = (np.bincount(row[alone], fewer[alone] == f, minlength=y - x).astype(np.int64) for f in (False, True))
            weight, size = percent * more + 100 * less, more + less
            excess = weight - (100 - percent) * n
            linked = np.flatnonzero((excess <= 0) & (n > 0))
            none = np.zeros(len(linked), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a[x:y][linked], b[x:y][linked], none, none.astype(np.int32), none, none)], names)
            of = row[alone]
            left = size[of] - np.arange(len(of)) + (np.cumsum(size) - size)[of]
            far = (excess > 0)[of]
            short = left * (100 + percent) >= weight[of] + least
            # A near one has at most as much as (100 - percent) n, so it can't reach one too far away.
            within = excess * percent <= 100 * (100 - percent) * n
            long = far & within[of] & (left * 100 >= excess[of])
            cap = left * (100 + percent) - weight[of]
            given = sides[x:y][of]
            named = full[alone] * _MULTIPLIERS[0] + K.mix(b[x:y][of].view(np.uint64)) + fewer[alone].astype(np.uint64)
            # Which lists a member is in, by its side so far: (who, side from now on, salt of the list, far's excess, capped).
            lists = (
                ((given & BOTH > 0) & far & short, BOTH, 3, True, True), ((given & (BOTH | ONE) > 0) & long, ONE, 4, True, False),
                ((given & (BOTH | OTHER) > 0) & ~far & short, OTHER, 4, False, True),
                ((given & ONE > 0) & far & short, ONE, 5, True, True), ((given & OTHER > 0) & far & short, OTHER, 5, True, True),
                ((given & OTHER > 0) & long, ONE, 6, True, False), ((given & ONE > 0) & ~far & short, OTHER, 6, False, True),
            )
            for who, side, salt, exceeds, capped in lists:
                at = np.flatnonzero(who)
                for i in range(0, len(at), 50_000):
                    j = at[i : i + 50_000]
                    doc = x + of[j]
                    most = cap[j] if capped else np.full(len(j), _NO_CAP)
                    cols = a[doc], b[doc], signed(K.mix(named[j] ^ _SALTS[salt])), np.full(len(j), side, np.int32), excess[of[j]] * exceeds, most
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], names)

    return arrow_map(_compared(pairs, texts, "sides"), step, _DEVIATIONS)


def _links(sigs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc, comp) of the linked class representatives. sigs: one row per class."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    bands = sigs.select("doc", F.explode("bands").alias("h"))

    def check(pairs: DataFrame, name: str) -> DataFrame:
        """Candidate pairs whose sketches allow a link and whose sets confirm it."""
        return written(_confirmed(pairs, texts, k, percent).distinct(), f"confirmed-{name}")

    heads = written(bands.groupBy("h").agg(F.min("doc").alias("b"), F.count("*").alias("n")).where("n > 1").select("h", "b"), "buckets")
    starred = bands.join(heads, "h").where("doc > b").groupBy(F.col("doc").alias("a")).agg(F.min("b").alias("b"))
    labels = components(check(written(_estimated(starred, sigs, percent), "candidates-star"), "star"))
    level = 0
    members = bands.join(heads.select("h"), "h", "left_semi").select("h", "doc", F.lit(BOTH).alias("side"), F.lit(0).cast("long").alias("excess"), F.lit(_NO_CAP).alias("cap"))
    while True:
        small, large = _open(members, labels, SMALL if level < LEVELS else None)
        level += 1
        new = []
        if not small.isEmpty():
            new.append(check(_pairs(small, sigs, percent), "small"))
        last = large is None or large.isEmpty()
        if not last:
            found = written(_deviations(written(_pivoted(large), "pivoted"), texts, k, percent), "deviations")
            new.append(found.where("side = 0").select("a", "b"))
            members = found.where("side > 0").select("h", F.col("a").alias("doc"), "side", "excess", "cap")
        if any(not x.isEmpty() for x in new):
            # Components so far are links of each document with its smallest.
            labels = components(reduce(DataFrame.union, new, labels.where("doc <> comp").select(F.col("doc").alias("a"), F.col("comp").alias("b"))))
        if last:
            return labels
        members = _fitting(members)


def _fitting(members: DataFrame) -> DataFrame:
    """Members of a bucket that fit at least one other by side, excess and cap, as far as extremes tell."""
    of = lambda f, c, side: f(F.when(F.col("side") == side, F.col(c)))
    known = members.groupBy("h").agg(
        F.count("*").alias("n"), of(F.min, "excess", BOTH).alias("e1"), of(F.max, "cap", BOTH).alias("c1"), of(F.min, "excess", ONE).alias("e2"), of(F.max, "cap", ONE).alias("c2"),
        of(F.min, "excess", OTHER).alias("e4"), of(F.max, "cap", OTHER).alias("c4"),
    )
    known = written(known.where("n > 1 and (e1 is not null or e2 <= c4 and e4 <= c2)").drop("n"), "shared")
    fits = reduce(lambda x, s: x | ((F.col("side") == s[0]) & (F.col("excess") <= F.col(f"c{s[1]}")) & (F.col("cap") >= F.col(f"e{s[1]}"))), ((BOTH, 1), (ONE, 4), (OTHER, 2)), F.lit(False))
    return members.join(known, "h").where(fits).select(members.columns)


def _open(members: DataFrame, labels: DataFrame, small: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Members of the buckets that have several components, with comp and n: small and large buckets."""
    rows = written(members.join(labels, "doc", "left").withColumn("comp", F.coalesce("comp", "doc")), "members")
    mixed = rows.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n"), F.bit_or("side").alias("sides")).where(f"x < y and sides not in ({ONE}, {OTHER})")
    rows = written(rows.join(written(mixed.select("h", "n"), "mixed"), "h"), "open")
    return (rows, None) if small is None else (rows.where(F.col("n") <= small), rows.where(F.col("n") > small))


def _pairs(members: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's members in different components that sides, caps and sketches allow.

    All of that is in the join's condition, so that no other pair is made.
    """
    one, two = (
        members.select("h", F.col("doc").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("side", "excess", "cap", "comp"))).join(_sketch(sigs, x), x)
        for x in "ab"
    )
    sides = (F.col("a_side") * F.col("b_side")).isin(BOTH * BOTH, ONE * OTHER)
    fits = (F.col("a") > F.col("b")) & (F.col("a_comp") != F.col("b_comp")) & sides & (F.col("a_excess") <= F.col("b_cap")) & (F.col("b_excess") <= F.col("a_cap"))
    found = written(one, "one").join(written(two, "two"), "h").where(fits & may_link("a", "b", percent))
    return written(found.select("a", "b").distinct(), "candidates-small")


def _pivoted(members: DataFrame) -> DataFrame:
    """Every member (a) with the pivots (b) of its buckets, and its sides there.

    The pivot is the document that meets most others in all its buckets, in buckets of sides one of the
    OTHER. It need not be in the bucket: what members know of better ones in their other buckets goes
    round once, so that the buckets of a group share a pivot and a member is compared with few.
    """
    known = written(members.groupBy("doc").agg(F.sum("n").alias("met")), "met")
    best = members.where(F.col("side") != ONE).join(known, "doc").groupBy("h").agg(F.max(F.struct("met", -F.col("doc"))).alias("m"))
    seen = members.join(written(best, "pivots"), "h").groupBy("doc").agg(F.max("m").alias("m"))
    best = members.join(written(seen, "pivots"), "doc").groupBy("h").agg(F.max("m").alias("m"))
    best = written(best.select("h", (-F.col("m.col2")).alias("b")), "pivots")
    return members.join(best, "h").where("doc <> b").groupBy(F.col("doc").alias("a"), "b").agg(F.bit_or("side").cast("long").alias("sides"))


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Written table (doc_id, n_shingles, component_id, kept), one row per row of docs."""
    sigs = written(signatures(docs, k), "signatures")
    sets = sigs.where("n > 0 and doc is not null")
    classes = written(sets.groupBy("d1", "d2", "n").agg(F.min("doc").alias("rep")), "classes")
    # A row's class; a doc_id with several texts is in several classes.
    member = written(sets.select("doc", "d1", "d2", "n").join(classes, ["d1", "d2", "n"]).select("doc", "rep").distinct(), "member")
    first = sets.join(classes.withColumnRenamed("rep", "doc"), ["d1", "d2", "n", "doc"], "left_semi").dropDuplicates(["doc", "d1", "d2", "n"])
    labels = _all_labels(written(first.drop("d1", "d2"), "representatives"), member, docs, k, percent)
    return sigs.join(labels, "doc", "left").select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("comp", "doc").alias("component_id"),
        F.coalesce(F.coalesce("comp", "doc") == F.col("doc"), F.lit(True)).alias("kept"),
    )


def _all_labels(sigs: DataFrame, member: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc, comp) of documents that aren't alone."""
    linked = _links(sigs, docs, k, percent)
    if member.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        known = linked.withColumnRenamed("doc", "rep")
        return written(member.join(known, "rep", "left").select("doc", F.coalesce("comp", "rep").alias("comp")), "components")
    # Documents in several classes tie them together.
    groups = member.where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    chains = linked.where("doc <> comp").select(F.col("doc").alias("a"), F.col("comp").alias("b"))
    return components(groups.union(chains))


def measure(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    return link(docs, k, percent)


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group, that with the smallest doc_id; all columns stay."""
    gone = link(docs, k, percent).where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__id"], "left_anti")


def brute(docs: list[tuple[int | None, str | None]], k: int = 4, percent: int = 80) -> list[tuple]:
    """The same rows by comparing all pairs, for tests."""
    sets = []
    for _, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "")
        w = [x for x in low.split(" ") if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, _) in enumerate(docs):
        for j in range(i):
            e = docs[j][0]
            if d is None or e is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else find(d), d is None or find(d) == d) for (d, _), s in zip(docs, sets, strict=True)]
