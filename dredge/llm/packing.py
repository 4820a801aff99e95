"""Best-fit packing of token sequences with certified bounds.

A document's tokens are its ids of a public tokenizer and an end mark. Only a document longer than
`capacity` is cut: its first piece takes the remainder, all others are full. Full pieces are
sequences of their own; the rest is bin packing with integer sizes.

Packing is distributed: pieces are dealt to partitions by their number, each partition packs by best-fit
decreasing, and a dual-feasible-function bound certifies how few bins any packing of that partition
needs. Bins of certified partitions are final. Where bins exceed the bound, the partition keeps its full
bins and hands the pieces of all others on; in the next round, with fewer partitions of about the same
size, they meet pieces of other partitions and are packed again, until no gap, or after ROUNDS rounds.
The column `certified` tells whether a sequence's partition met its bound; full sequences always do.

Null and empty texts have the end mark alone. Rows that repeat a doc_id are pieces of their own. Rows
without doc_id are packed as well. Extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dredge.llm.common import settle, written

CAPACITY = 2048
#: Entries of a task's cache of encoded words, pieces of a partition on average, and rounds of packing.
CACHE, PART_PIECES, ROUNDS = 150_000, 50_000, 4


#: Fixed value: how the byte-level pre-tokenizer splits text.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _encode(path: str):
    """A function text -> ids with the ids of the tokenizer file, and what its added tokens are in a text.

    A plain byte-level BPE whose ids ascend in the order of its merges gives the same ids in tiktoken,
    which takes a third of the time for a rare word; any other file, and any text with an added token, is
    run by tokenizers.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    added = tuple(x["content"] for x in spec.get("added_tokens", []))
    t = Tokenizer.from_file(path)
    whole = lambda text: t.encode(text, add_special_tokens=False).ids
    plain = (
        model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not spec.get("normalizer") and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    )
    if plain:
        vocab, letters = model["vocab"], _byte_letters()
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if all(x is not None for x in merged) and all(a < b for a, b in zip(merged, merged[1:], strict=False)):
            import tiktoken

            ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in added}
            return tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, whole, added
    return whole, whole, added


class _Unsafe(Exception):
    """A part of a text that can't be encoded apart."""


class _Known(dict):
    """Ids of the parts met so far, each with the space before it."""

    def __init__(self, encode, space: str) -> None:
        super().__init__()
        self.encode, self.space = encode, space

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Unsafe
        if len(self) >= CACHE:
            self.clear()
        ids = array("I", self.encode(self.space + part)).tobytes()
        if len(part) < 64:
            self[part] = ids
        return ids


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    A single space between two characters that aren't white space always begins a token of its own
    pre-token, so the parts of a text between such spaces are encoded apart and remembered. A text
    with other white space beside a space is encoded whole, and so is one with an added token in it.
    """

    def __init__(self, path: str) -> None:
        self.encode, self.exact, self.added = _encode(path)
        self.first, self.later = _Known(self.encode, ""), _Known(self.encode, " ")

    def __call__(self, text: str) -> bytes:
        for token in self.added:
            if token in text:
                return array("I", self.exact(text)).tobytes()
        parts = text.split(" ")
        try:
            return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))
        except _Unsafe:
            return array("I", self.encode(text)).tobytes()


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, key long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece; key numbers the pieces: partition and place in it."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = Encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + end
                for i, (s, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * s : 4 * (s + n)])
                    rows.append((doc_id, i, s, n, crc, number))
                    number += 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])
        del encode
        settle()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Bins are found by their free space, so a piece costs O(log capacity)."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free: list[int] = []  # distinct free spaces in order
    open_bins: dict[int, list[int]] = {}
    used = 0
    for i in order.tolist():
        n = int(sizes[i])
        at = bisect.bisect_left(free, n)
        if at == len(free):
            b, space = used, capacity
            used += 1
        else:
            space = free[at]
            b = open_bins[space].pop()
            if not open_bins[space]:
                del open_bins[space]
                free.pop(at)
        bins[i], offsets[i] = b, capacity - space
        left = space - n
        if left:
            if left not in open_bins:
                bisect.insort(free, left)
            open_bins.setdefault(left, []).append(b)
    return bins, offsets


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Least number of bins by dual feasible functions.

    For each cut c up to half the capacity, sizes over capacity - c count as whole bins and sizes
    under c as nothing; and for each k, a size x counts as floor((k + 1) x / capacity) / k, or as
    x / capacity where that division is exact. The largest sum wins; all are exact in integers.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    mass, number = np.cumsum(count * x), np.cumsum(count)
    c = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - c]
    middle = mass[capacity - c] - mass[np.maximum(c - 1, 0)] * (c > 0)
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 21):
        part = (k + 1) * x
        u = np.where(part % capacity == 0, k * x, (part // capacity) * capacity)
        best = max(best, -(-int((count * u).sum()) // (k * capacity)))
    return best


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, key long, home long, bin long, offset long, loose boolean, certified boolean"


def _round(rows: DataFrame, number: int, parts: int, last: bool, capacity: int) -> DataFrame:
    """Pack each partition; loose pieces are those handed on. Bins are numbered in their partition."""
    given = [x.split()[0] for x in _PACKED.split(", ")][:6]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending")])
        home = table["home"].to_numpy()[0]
        sizes = table["length"].to_numpy()
        bins, offsets = best_fit_decreasing(sizes, capacity)
        n = int(bins.max()) + 1
        gap = n > lower_bound(sizes, capacity)
        loose = np.bincount(bins, sizes, minlength=n)[bins] < capacity if gap and not last else np.zeros(len(sizes), bool)
        sure = np.full(len(sizes), not gap)
        if gap:
            sure = np.bincount(bins, sizes, minlength=n)[bins] >= capacity
        out = table.select(given)
        for name, col in (("home", np.full(len(sizes), home)), ("bin", bins), ("offset", offsets), ("loose", loose), ("certified", sure)):
            out = out.append_column(name, pa.array(col))
        return out

    dealt = rows.select(*given, F.pmod(F.xxhash64("key", F.lit(number)), F.lit(parts)).alias("home"))
    return dealt.groupBy("home").applyInArrow(pack, _PACKED)


#: Bits of a sequence's number: bin in its partition (as many as it can have pieces by far), partition, round.
_BIN, _HOME = 22, 36


def pack(rows: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """sequence_id, offset and certified of each piece (columns as `pieces` gives them, without key).

    key must be unique. Sequences are gapless from 0. Their ids: round, partition and bin in one long;
    full pieces have the negative of their key, less one.
    """
    known = rows.where(F.col("length") < capacity)
    full = rows.where(F.col("length") >= capacity)
    kept = []
    for number in range(rounds):
        parts = -(-known.count() // PART_PIECES) or 1
        last = number == rounds - 1 or parts == 1
        packed = written(_round(known, number, parts, last, capacity), f"packed{number}")
        sequence = F.col("bin").bitwiseOR(F.shiftleft("home", _BIN)).bitwiseOR(F.lit(number << (_BIN + _HOME)))
        kept.append(packed.where("not loose").withColumn("sequence_id", sequence))
        known = packed.where("loose")
        if last or known.isEmpty():
            break
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"]
    out = full.select(*cols[:5], (-F.col("key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    return reduce(DataFrame.unionByName, (k.select(cols) for k in kept), out)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    return pack(written(pieces(docs, path, capacity, end_id), "pieces"), capacity)
