"""Exact repeated windows across a corpus, without pairs of documents.

A *window* is `span` consecutive units (words or bytes) of one document. A window is *covered* if it
also starts earlier; callers remove what covered windows cover. The work is done on winnowed
anchors, so only about one row per (span - k + 2) / 2 units is ever shuffled:

1.  Seeds. Of every window the least of its k-unit grams is its anchor (`kernel.Winnowed`). Equal
    windows have equal anchors, so an anchor that occurs once settles all windows it stands for.
    Occurrences are counted with a native partial aggregation, which takes hot anchors.
2.  Extension, both ways. The consecutive windows with one anchor form a *run*, the anchor with all
    the text to its left and right that those windows reach. Runs are keyed by their content; the
    earliest holder of each distinct run is a native minimum. Every other holder is covered whole.
    Copies of any number end here, in one row per distinct run.
3.  Refinement. Where an anchor has several distinct runs, their earliest holders hand over the
    text of the run, grouped by anchor, and single windows are compared. An anchor with more than
    HOT distinct runs is salted: its windows go to a native minimum per window instead of a task.
4.  Places of covered windows return to their documents, and neighbours join to maximal spans.

Equality is told by hashes: runs by 128 bits (anchor and content), the windows of a slab by 64. A slab of
w windows mixes two of them up with a chance of w**2 / 2**65, 10**-7 at two million; nothing else is inexact.

Places carry 32 bits of the run's content, so that rows which repeat a doc_id with another text only
take what is theirs. Rows without doc_id take no part: nothing of them is covered and they cover
nothing. Null and empty texts have no windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dredge.llm import kernel as K
from dredge.llm.common import arrow_map, binary, gather, int64, partitions, settle, signed, written

#: Distinct runs of one anchor that one task compares; beyond, windows are keyed one by one.
HOT = 1500
#: Rows with run texts that a task compares at a time, rounded up to whole anchors.
SLAB = 4_000


@dataclass(frozen=True)
class Unit:
    """What windows are made of: span and gram length in units, bytes or words, and the order.

    within: whether a window that starts earlier in the same document counts as earlier.
    """

    span: int
    k: int
    words: bool
    within: bool

    def parse(self, buf: np.ndarray, offs: np.ndarray) -> Parsed:
        return Parsed(self, buf, offs)


class Parsed:
    """Units, winnowed runs and run hashes of a block of texts."""

    def __init__(self, unit: Unit, buf: np.ndarray, offs: np.ndarray) -> None:
        self.buf, self.unit = buf, unit
        if unit.words:
            self.starts, self.ends, self.offs = K.word_spans(buf, offs, K.SPACES)
            self.values = K.word_hashes(buf, self.starts, self.ends)
            grams = K.gram_hash(self.values, unit.k)
            self.sums = K.prefix_sums(self.values)
        else:
            self.offs, self.values = offs, K.byte_values(buf)
            self.sums = K.prefix_sums(self.values)
            grams = K.rolling_hash(self.sums, unit.k)
        w = self.win = K.Winnowed(self.values, self.offs, unit.k, unit.span, grams)
        place = (w.anchor - w.first).astype(np.uint64)
        self.run = K.mix(K.span_hash(self.sums, w.first, w.last + unit.span) + place) if len(w.first) else np.zeros(0, np.uint64)
        self.pos = w.first - self.offs[w.row] if len(w.first) else np.zeros(0, np.int64)

    def content(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the runs `at`, end to end, with offsets."""
        a, b = self.win.first[at], self.win.last[at] + self.unit.span
        if self.unit.words:
            a, b = self.starts[a], self.ends[b - 1]
        return gather(self.buf, a, b - a)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(ids, bytes, offsets, first row, end row) of the blocks of a (doc_id, text, ...) batch."""
    ids = int64(batch.column(0))
    buf, offs = K.column_bytes(batch.column(1))
    for a, b in K.blocks(offs):
        yield ids[a:b], buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], a, b


def _batch(schema: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], schema)


def anchors(docs: DataFrame, unit: Unit, full: bool) -> DataFrame:
    """(h, doc), and with full also (r, pos), of every run."""
    names = ["h", "doc", "r", "pos"] if full else ["h", "doc"]

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for ids, buf, offs, _, _ in _blocks(batch):
            p = unit.parse(buf, offs)
            if len(p.win.first):
                cols = [signed(p.win.gram), ids[p.win.row]]
                yield _batch(names, *cols, *([signed(p.run), p.pos.astype(np.int64)] if full else []))

    kept = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return arrow_map(kept, step, ", ".join(f"{n} long" for n in names))


def _runs(docs: DataFrame, unit: Unit) -> DataFrame:
    """Written table of (h, r, doc, pos) for anchors that occur twice or more."""
    if unit.within:
        shared = anchors(docs, unit, False).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    else:
        shared = anchors(docs, unit, False).groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("h")
    # Written first: a join of two plain shuffles can split the rows of a hot anchor, one on top of an aggregate can't.
    return written(anchors(docs, unit, True).join(written(shared, "shared"), "h", "left_semi"), "runs")


def _places(runs: DataFrame, unit: Unit) -> DataFrame:
    """Written table doc_id -> places: (pos, r32, n); n = 0: covered run, else distinct runs of its anchor."""
    first = F.min(F.struct("doc", "pos")) if unit.within else F.min(F.struct("doc"))
    distinct = written(runs.groupBy("h", "r").agg(first.alias("m")), "distinct")
    several = written(distinct.groupBy("h").agg(F.count("*").alias("n")), "several")
    known = distinct.join(several, "h").select("h", "r", "m", "n")
    here = F.struct("doc", "pos") if unit.within else F.struct("doc")
    joined = runs.join(known, ["h", "r"]).withColumn("late", here > F.col("m"))
    place = F.struct(
        F.col("pos").cast("int").alias("pos"),
        F.shiftright(F.shiftleft("r", 32), 32).cast("int").alias("r32"),
        F.when(F.col("late"), 0).otherwise(F.least("n", F.lit(2**31 - 1))).cast("int").alias("n"),
    )
    found = joined.where("late or n > 1").groupBy("doc").agg(F.collect_list(place).alias("places"))
    return written(found.withColumnRenamed("doc", "doc_id"), "places")


def _match(p: Parsed, row_places: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Runs of the block that the rows' places name, with the named fields of those places."""
    flat = row_places.flatten()
    rows = np.repeat(np.arange(len(row_places)), row_places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    pos, r32 = (int64(flat.field(x)) for x in ("pos", "r32"))
    if not len(pos) or not len(p.pos):
        return np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in fields]
    unit = p.offs[rows] + pos
    at = np.minimum(np.searchsorted(p.win.first, unit), len(p.pos) - 1)
    ok = (p.win.first[at] == unit) & (p.win.row[at] == rows) & (p.run[at].astype(np.uint32).view(np.int32) == r32)
    return at[ok], [int64(flat.field(x))[ok] for x in fields]


_HANDED = "h long, salt int, hot boolean, doc long, pos int, r32 int, a int, text binary"


def _handed(docs: DataFrame, places: DataFrame, unit: Unit) -> DataFrame:
    """Texts of the runs that need refinement."""
    names = [x.split()[0] for x in _HANDED.split(", ")]
    wanted = F.filter("places", lambda x: x["n"] > 1)
    needed = places.select("doc_id", wanted.alias("places")).where(F.size("places") > 0)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for ids, buf, offs, a, b in _blocks(batch):
            p = unit.parse(buf, offs)
            at, (n,) = _match(p, batch.column(2).slice(a, b - a), "n")
            if not len(at):
                continue
            at, keep = np.unique(at, return_index=True)
            n, doc = n[keep], ids[p.win.row[at]]
            hot = n > HOT
            salts = np.maximum(1, -(-n // (HOT // 2))).astype(np.uint64)
            salt = np.where(hot, (K.mix(doc.view(np.uint64) + p.pos[at].astype(np.uint64)) % salts).astype(np.int32), 0)
            for i in range(0, len(at), 10_000):
                j = slice(i, i + 10_000)
                yield _batch(
                    names, signed(p.win.gram[at[j]]), salt[j].astype(np.int32), hot[j], doc[j], p.pos[at[j]].astype(np.int32),
                    p.run[at[j]].astype(np.uint32).view(np.int32), (p.win.anchor - p.win.first)[at[j]].astype(np.int32), binary(*p.content(at[j])),
                )

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").join(needed, "doc_id")
    return arrow_map(texts, step, _HANDED)


_REFINED = "doc long, pos int, r32 int, lo int, hi int, w1 long, w2 long"


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole (h, salt) groups from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) < SLAB:
            continue
        t = pa.Table.from_batches(held)
        h, s = t["h"].to_numpy(), t["salt"].to_numpy()
        cut = np.flatnonzero((h[1:] != h[:-1]) | (s[1:] != s[:-1])) + 1
        at = 0
        while len(cut) and cut[-1] - at >= SLAB:
            end = int(cut[np.searchsorted(cut, at + SLAB)])
            yield t.slice(at, end - at)
            at = end
        held = t.slice(at).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


#: (bytes, offsets, hot rows) -> (row, window in the row, two-part key) per window, in order. Keys name a
#: window among the given rows; those of hot rows must name it anywhere.
Identify = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def window_places(offs: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window in the row, first unit) of all windows of rows with these unit offsets."""
    n = np.maximum(np.diff(offs) - span + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    return row, place, offs[row] + place


def hashed_windows(unit: Unit) -> Identify:
    """Windows named by 128 bits of hash."""

    def identify(buf: np.ndarray, offs: np.ndarray, hot: np.ndarray):
        if unit.words:
            starts, ends, offs = K.word_spans(buf, offs, K.SPACES)
            values = K.word_hashes(buf, starts, ends)
        else:
            values = K.byte_values(buf)
        row, place, at = window_places(offs, unit.span)
        keys = [K.rolling_hash(K.prefix_sums(one), unit.span)[at] for one in (values, K.mix(values))]
        return row, place, np.stack(keys, 1)

    return identify


def _refine(handed: DataFrame, unit: Unit, identify: Identify) -> DataFrame:
    """Covered window ranges of the handed runs; rows with w1 are windows of hot anchors, one each."""
    names = [x.split()[0] for x in _REFINED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _slabs(batches):
            doc, pos, r32 = (int64(t[x].combine_chunks()) for x in ("doc", "pos", "r32"))
            hot = t["hot"].to_numpy()
            row, place, key = identify(*K.column_bytes(t["text"]), hot)
            if not len(row):
                continue
            # Runs of a document don't share windows, so (doc, pos) of the run orders windows, then place.
            # Rows that repeat a document and its text are at the same place.
            rank = np.empty(len(doc), np.int64)
            ahead = np.lexsort((pos, doc))
            fresh = np.append(True, (np.diff(doc[ahead]) != 0) | (np.diff(pos[ahead]) != 0))
            rank[ahead] = np.cumsum(fresh) - 1
            ahead = ahead[fresh]
            when = (rank[row] << 24) + place
            name = key[:, 0] ^ K.mix(key[:, 1])
            order = np.argsort(name)
            new = np.append(True, np.diff(name[order]) != 0)
            earliest = np.minimum.reduceat(when[order], np.flatnonzero(new))[np.cumsum(new) - 1]
            least = np.empty_like(earliest)
            least[order] = earliest
            late = when > least if unit.within else doc[row] > doc[ahead[least >> 24]]
            # Covered here, whatever other salts hold; other windows of hot anchors go on.
            r, w = row[late], place[late]
            if len(r):
                first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (w[1:] != w[:-1] + 1)))
                last = np.append(first[1:], len(r)) - 1
                q, none = r[first], pa.nulls(len(first), pa.int64())
                yield _batch(names, doc[q], pos[q].astype(np.int32), r32[q].astype(np.int32), w[first].astype(np.int32), w[last].astype(np.int32), none, none)
            on = np.flatnonzero(hot[row] & ~late)
            for i in range(0, len(on), 50_000):
                at = on[i : i + 50_000]
                q, w = row[at], place[at].astype(np.int32)
                yield _batch(names, doc[q], pos[q].astype(np.int32), r32[q].astype(np.int32), w, w, signed(np.ascontiguousarray(key[at, 0])), signed(np.ascontiguousarray(key[at, 1])))
        settle()

    n = partitions(handed.sparkSession)
    return handed.repartition(n, "h", "salt").sortWithinPartitions("h", "salt").mapInArrow(run, _REFINED)


def covered_places(docs: DataFrame, unit: Unit, identify: Identify) -> DataFrame:
    """Written table doc_id -> places of covered windows: (pos, r32, lo, hi); hi = -1: the whole run."""
    places = _places(_runs(docs, unit), unit)
    refined = written(_refine(_handed(docs, places, unit), unit, identify), "refined")
    hot = refined.where("w1 is not null")
    order = F.struct("doc", (F.col("pos") + F.col("lo")).alias("at")) if unit.within else F.struct("doc")
    least = hot.groupBy("w1", "w2").agg(F.min(order).alias("m"), F.max(order).alias("x")).where("m < x").drop("x")
    late = hot.join(least, ["w1", "w2"]).where(order > F.col("m"))
    part = F.struct("pos", "r32", "lo", "hi").alias("place")
    ranges = refined.where("w1 is null").select("doc", part).unionByName(late.select("doc", part))
    per_doc = ranges.groupBy("doc").agg(F.collect_list("place").alias("ranges")).withColumnRenamed("doc", "doc_id")
    whole = F.transform(
        F.filter("places", lambda x: x["n"] == 0),
        lambda x: F.struct(x["pos"].alias("pos"), x["r32"].alias("r32"), F.lit(0).alias("lo"), F.lit(-1).alias("hi")),
    )
    none = F.array().cast("array<struct<pos:int,r32:int,lo:int,hi:int>>")
    both = places.select("doc_id", whole.alias("whole")).join(per_doc, "doc_id", "left")
    both = both.select("doc_id", F.concat("whole", F.coalesce("ranges", none)).alias("places"))
    return written(both.where(F.size("places") > 0), "covered")


def removal(unit: Unit, buf: np.ndarray, offs: np.ndarray, unit_offs: np.ndarray, row_places: pa.Array) -> np.ndarray:
    """Mask of the block's units (row offsets unit_offs) that covered windows cover.

    Only rows with places are parsed.
    """
    gone = np.zeros(unit_offs[-1], bool)
    rows = np.flatnonzero(row_places.is_valid().to_numpy(zero_copy_only=False))
    if not len(rows):
        return gone
    part, ends = gather(buf, offs[rows], offs[rows + 1] - offs[rows])
    p = unit.parse(part, ends)
    mask = _removal(p, row_places.take(pa.array(rows)))
    size = np.diff(p.offs)
    gone[np.repeat(unit_offs[rows] - p.offs[:-1], size) + np.arange(len(mask))] = mask
    return gone


def _removal(p: Parsed, row_places: pa.Array) -> np.ndarray:
    at, (lo, hi) = _match(p, row_places, "lo", "hi")
    a = p.win.first[at] + lo if len(at) else at
    b = np.where(hi < 0, p.win.last[at], p.win.first[at] + hi) + p.unit.span if len(at) else at
    return K.covered(len(p.values), a, b)


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Every row of docs with the places of its doc_id as last column, __places."""
    known = places.select(F.col("doc_id").alias("__id"), F.col("places").alias("__places"))
    return docs.join(known, docs["doc_id"].cast("long") == known["__id"], "left").drop("__id")
