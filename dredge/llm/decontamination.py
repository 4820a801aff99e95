"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark passages.

A window is `span` consecutive words of a benchmark item, or the whole of a shorter one. The automaton's
patterns are grams of GRAM words at every (span - GRAM + 1)-th place of an item, so that every window
holds one; they take a thirteenth of the memory that the windows themselves would. Each document is
normalised once (ASCII letters to lower case, words by a space) and scanned once. Where a gram is found,
its neighbours in the text are compared with those in the item, both ways, and every window that agrees
is a hit: a place in words, which `spans` maps to characters of the original text.

The items go to the executors. A benchmark does not grow with the corpus; should one exceed BLOCK_WORDS,
it is worked off in blocks of that many words (some 300 bytes a word in a task), each with an automaton of
its own. Rows get a key before the blocks, and their hits are merged by it: repeated and null doc_ids stay
rows of their own.

Null text has no words and no hits. Empty tables give empty results. Items without words are never
found. Extra columns are ignored by `measure` and kept by `drop_contaminated` and `clean`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dredge.llm.common import settle, written

SPAN, GRAM = 13, 5
BLOCK_WORDS = 1_000_000
_KEY = "__row"

#: Bytes that are part of a word keep their value (ASCII letters in lower case), others become a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Normalised words of a text."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Matcher:
    """The automaton of some items, and what it finds."""

    def __init__(self, items: tuple[tuple, ...], span: int) -> None:
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        #: Per gram its distinct surroundings: words before it, after it, windows' length, and the items with them.
        found: dict[bytes, dict[tuple, set]] = {}
        for item_id, text in items:
            w = words(text)
            n = min(span, len(w))
            k = min(GRAM, n)
            reach = n - k
            for i in range(0, len(w) - k + 1 if n else 0, reach + 1):
                around = (tuple(w[max(0, i - reach) : i]), tuple(w[i + k : i + k + reach]), n)
                found.setdefault(b" " + b" ".join(w[i : i + k]) + b" ", {}).setdefault(around, set()).add(item_id)
        for key, places in found.items():
            self.auto.add_word(key.decode("latin-1"), (len(key), key.count(b" ") - 1, tuple((*x, tuple(ids)) for x, ids in places.items())))
        if found:
            self.auto.make_automaton()

    def __len__(self) -> int:
        return len(self.auto)

    def hits(self, w: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Mask of the words hit (null if there are none), and the items found."""
        scanned = b" " + b" ".join(w) + b" "
        met = [(end + 1 - size, k, places) for end, (size, k, places) in self.auto.iter(scanned.decode("latin-1"))]
        if not met:
            return None, set()
        at = np.cumsum(np.frombuffer(scanned, np.uint8) == 32)[[x[0] for x in met]] - 1
        edge, items = np.zeros(len(w) + 1, np.int64), set()
        for j, (_, k, places) in zip(at.tolist(), met, strict=True):
            for before, after, n, ids in places:
                left, right = 0, 0
                while left < len(before) and left < j and w[j - 1 - left] == before[-1 - left]:
                    left += 1
                while right < len(after) and j + k + right < len(w) and w[j + k + right] == after[right]:
                    right += 1
                if left + k + right >= n:
                    edge[j - left] += 1
                    edge[j + k + right] -= 1
                    items.update(ids)
        return (np.cumsum(edge[:-1]) > 0, items) if items else (None, items)


@lru_cache(maxsize=2)
def matcher(items: tuple[tuple, ...], span: int) -> Matcher:
    return Matcher(items, span)


def _blocks(benchmark: DataFrame) -> Iterator[tuple[tuple, ...]]:
    """Blocks of whole items with at most BLOCK_WORDS words (an item larger than that alone), words joined by a space."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        w = words(row["text"])
        if held and size + len(w) > BLOCK_WORDS:
            yield tuple(held)
            held, size = [], 0
        if w:
            held.append((row["item_id"], b" ".join(w).decode()))
            size += len(w)
    yield tuple(held)


def scan(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, hit (places of hit words), items (ids found), for each document."""
    blocks = list(_blocks(benchmark))
    if len(blocks) == 1:
        return _scanned(docs, blocks, span)
    rows = _keyed(docs.select(F.col("doc_id").cast("long"), "text"))
    found = _scanned(rows.select(F.col(_KEY).alias("doc_id"), "text"), blocks, span).withColumnRenamed("doc_id", _KEY)
    return rows.drop("text").join(found, _KEY).drop(_KEY)


def _keyed(docs: DataFrame) -> DataFrame:
    """Written table of docs and _KEY, a number of the row."""
    return written(docs.withColumn(_KEY, F.monotonically_increasing_id()), "decontamination-rows")


def _scanned(docs: DataFrame, blocks: list[tuple], span: int) -> DataFrame:
    """scan() with given blocks; doc_id tells rows apart if there is more than one."""
    ids = pa.int64()
    parts = []
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            auto = matcher(shared.value, span)
            for batch in batches:
                n_words, hit, items = [], [], []
                for text in batch.column(1).to_pylist():
                    w = words(text)
                    mask, found = auto.hits(w) if w and len(auto) else (None, ())
                    n_words.append(len(w))
                    hit.append([] if mask is None else np.flatnonzero(mask).tolist())
                    items.append(sorted(map(str, found)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(ids), pa.array(n_words, ids), pa.array(hit, pa.list_(ids)), pa.array(items, pa.list_(pa.string()))],
                    ["doc_id", "n_words", "hit", "items"],
                )

        parts.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, hit array<long>, items array<string>"))
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    joined = every.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return joined


def measure(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, share: int = 20) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    found = scan(docs, benchmark, span)
    n_hit = F.size("hit").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def spans(text: str, hit: list[int]) -> list[tuple[int, int]]:
    """Character ranges of the original text that the hit words cover, neighbours joined."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    folded = raw.translate(_FOLD)
    inside = np.append(np.frombuffer(folded, np.uint8) != 32, False)
    before = np.append(False, inside[:-1])
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    chars = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    out: list[tuple[int, int]] = []
    last = None
    for i in sorted(hit):
        a, b = int(chars[starts[i]]), int(chars[ends[i]])
        if last is not None and i == last + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        last = i
    return out


def without(text: str, hit: list[int]) -> str:
    """The text without the characters that the hit words cover."""
    at, out = 0, []
    for a, b in spans(text, hit):
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, share: int = 20) -> DataFrame:
    """Documents, with all their columns, that are not contaminated: one narrow pass, no shuffle.

    With a benchmark of more than one block the keys of contaminated rows are joined instead.
    """
    blocks = list(_blocks(benchmark))
    if len(blocks) == 1:
        return _one_pass(docs, blocks[0], span, share, False)
    rows = _keyed(docs)
    n_hit = F.size("hit").cast("long")
    bad = _scanned(rows.select(F.col(_KEY).alias("doc_id"), "text"), blocks, span).where((n_hit > 0) & (share * n_hit >= F.col("n_words")))
    return rows.join(bad.select(F.col("doc_id").alias(_KEY)), _KEY, "left_anti").select(docs.columns)


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, share: int = 20) -> DataFrame:
    """Documents, with all their columns, that are not contaminated, without the words hit in them.

    Words that come together where a passage was cut out may be a passage themselves, so a text is
    scanned until it has no hit; what is contaminated is told by the text as it came. n_chars, if there
    is one, is counted anew where text has changed. One narrow pass; with a benchmark of more than one
    block, a written table per scan.
    """
    blocks = list(_blocks(benchmark))
    if len(blocks) == 1:
        return _one_pass(docs, blocks[0], span, share, True)
    names = docs.columns
    rows = _keyed(docs)
    done, first = [], True
    while True:
        every = _scanned(rows.select(F.col(_KEY).alias("doc_id"), "text"), blocks, span)
        found = written(every.where(F.size("hit") > 0).select(F.col("doc_id").alias(_KEY), "n_words", F.col("hit").alias("__hit")), "decontamination-hits")
        done.append(rows.join(found, _KEY, "left_anti"))
        if first:
            found, first = found.where(share * F.size("__hit") < F.col("n_words")), False
        if found.isEmpty():
            return reduce(DataFrame.unionByName, done).select(names)
        rows = written(_cut(rows.join(found.select(_KEY, "__hit"), _KEY).select(*names, _KEY, "__hit")), "decontamination-rows")


def _changed(batch: pa.RecordBatch, texts: list, changed: list[int]) -> list[pa.Array]:
    """The columns of a batch with new texts, and n_chars of those that have changed."""
    cols = list(batch.columns)
    if changed:
        for name in {"text", "n_chars"} & set(batch.schema.names):
            i = batch.schema.names.index(name)
            values = texts
            if name == "n_chars":
                values = cols[i].to_pylist()
                for x in changed:
                    values[x] = len(texts[x])
            cols[i] = pa.array(values, pa.string() if name == "text" else pa.int64()).cast(cols[i].type)
    return cols


def _cut(rows: DataFrame) -> DataFrame:
    """Rows without the words at __hit in their text, and without that column."""
    kept = [x for x in rows.columns if x != "__hit"]
    place = kept.index("text")

    def run(batches):
        for batch in batches:
            hits = batch.column(batch.num_columns - 1).to_pylist()
            texts = [without(t, h) for t, h in zip(batch.column(place).to_pylist(), hits, strict=True)]
            cols = _changed(batch, texts, list(range(len(texts))))
            yield pa.RecordBatch.from_arrays(cols[:-1], kept)
        settle()

    return rows.mapInArrow(run, rows.select(kept).schema)


def _one_pass(docs: DataFrame, block: tuple, span: int, share: int, cut: bool) -> DataFrame:
    """Documents that are not contaminated; with `cut` without the words hit in them."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    place = docs.columns.index("text")

    def run(batches):
        auto = matcher(shared.value, span)
        for batch in batches:
            keep, changed = [], []
            texts = batch.column(place).to_pylist()
            for i, text in enumerate(texts):
                w = words(text)
                mask, _ = auto.hits(w) if w and len(auto) else (None, ())
                n = 0 if mask is None else int(mask.sum())
                keep.append(not (n and share * n >= len(w)))
                if cut and n and keep[-1]:
                    changed.append(i)
                    while mask is not None:
                        texts[i] = without(texts[i], np.flatnonzero(mask).tolist())
                        w = words(texts[i])
                        mask, _ = auto.hits(w) if w else (None, ())
            new = pa.RecordBatch.from_arrays(_changed(batch, texts, changed), batch.schema.names)
            yield new.filter(pa.array(keep, pa.bool_()))
        settle()

    return docs.mapInArrow(run, docs.schema)


def brute(docs: list[tuple], items: list[tuple], span: int = SPAN) -> list[tuple]:
    """The same figures by plain comparison of word lists, for tests."""
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            p = words(item)
            n = min(span, len(p))
            for i in range(len(p) - n + 1 if p else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == p[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(item_id)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out
