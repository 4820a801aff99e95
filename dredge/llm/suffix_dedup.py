"""Suffix-array dedup on bytes: distributed bucket-pointer refinement of repeated 100-byte strings.

Texts are UTF-8 bytes. A string of `span` bytes repeats if it also starts earlier: in a smaller
doc_id, or in the same document at an earlier byte. The bytes that repeated strings cover go; judged
on the input. Strings do not cross documents.

All suffixes that can share `span` bytes are brought together in buckets first, by the winnowed
anchor of the string (see `repeats`), so no suffix array of the corpus is held anywhere. Within the
buckets `refine` is bucket-pointer refinement: suffixes start in buckets of their first `q` bytes;
a bucket is refined by sorting on the bucket pointers that its suffixes have at a later offset, and
the refined pointers are what the next, twice as deep refinement reads. Buckets of one suffix leave.
Buckets of hot anchors go on to a native minimum per string, so no bucket of any size meets in one task.

Null and empty texts have no bytes. Rows without doc_id are left whole. Extra columns are kept by
`dedup` and ignored by `measure`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dredge.llm import kernel as K
from dredge.llm import repeats as R

SPAN, GRAM, Q = 100, 40, 25


def _buckets(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the keys, and the place of its bucket's first suffix for each place in it."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    return order, np.flatnonzero(new)[np.cumsum(new) - 1]


def _pointers(key: np.ndarray) -> np.ndarray:
    """Bucket pointer of each suffix."""
    order, first = _buckets(key)
    out = np.empty(len(key), np.int64)
    out[order] = first
    return out


def refine(buf: np.ndarray, starts: np.ndarray, span: int, q: int = Q) -> np.ndarray:
    """Bucket pointers by the first `span` bytes of the suffixes at `starts`, which have that many.

    Initial buckets are those of the first q bytes. In each round a bucket with company is sorted on
    the pointers its suffixes have `deep` bytes later, which doubles the depth; the refined pointers
    replace the old ones and serve the next round.
    """
    n, q = len(buf) - min(q, span) + 1, min(q, span)
    if not len(starts):
        return np.zeros(0, np.int64)
    pointer, deep = _pointers(K.rolling_hash(K.prefix_sums(K.byte_values(buf)), q)), q
    while deep * 2 < span:
        size = np.bincount(pointer, minlength=n)
        at = np.flatnonzero(size[pointer[: n - deep]] > 1)
        order, first = _buckets(pointer[at] * n + pointer[at + deep])
        old = pointer[at][order]
        head = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        base = np.repeat(head, np.diff(np.append(head, len(old))))
        after = pointer.copy()
        after[at[order]] = old + first - base
        pointer, deep = after, deep * 2
    if deep == span:
        return pointer[starts]
    return _pointers(pointer[starts] * n + pointer[starts + span - deep])


def unit(span: int = SPAN) -> R.Unit:
    return R.Unit(span=span, k=max(1, min(GRAM, span * 2 // 5)), words=False, within=True)


def _identify(u: R.Unit) -> R.Identify:
    hashed = R.hashed_windows(u)

    def identify(buf: np.ndarray, offs: np.ndarray, hot: np.ndarray):
        row, place, at = R.window_places(offs, u.span)
        key = np.zeros((len(row), 2), np.uint64)
        cold = ~hot[row]
        if cold.any():
            key[cold, 0] = refine(buf, at[cold], u.span).astype(np.uint64)
        if hot.any():
            key[~cold] = hashed(buf, offs, hot)[2][~cold]
        return row, place, key

    return identify


def repeated(docs: DataFrame, span: int = SPAN) -> DataFrame:
    u = unit(span)
    return R.covered_places(docs, u, _identify(u))


def measure(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of every row."""
    u = unit(span)
    rows = R.with_places(docs.select("doc_id", "text"), repeated(docs, span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.column_bytes(batch.column(1))
            for a, b in K.blocks(offs):
                ends = offs[a : b + 1] - offs[a]
                places = batch.column(2).slice(a, b - a)
                raw = buf[offs[a] : offs[b]]
                gone = R.removal(u, raw, ends, ends, places)
                first = gone.copy()
                if len(gone):
                    first[1:] &= ~gone[:-1]
                    heads = ends[:-1][ends[:-1] < len(gone)]
                    first[heads] = gone[heads]
                removed, spans = (np.diff(np.append(0, np.cumsum(x))[ends]) for x in (gone, first))
                kept, cut = raw[~gone].tobytes(), np.append(0, np.cumsum(np.diff(ends) - removed))
                digests = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(np.diff(ends)), pa.array(removed), pa.array(spans), pa.array(digests, pa.string())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs with the repeated bytes cut out; a character that loses some of its bytes goes whole."""
    u = unit(span)
    place, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(place)
            buf, offs = K.column_bytes(col)
            for a, b in K.blocks(offs):
                ends = offs[a : b + 1] - offs[a]
                gone = R.removal(u, buf[offs[a] : offs[b]], ends, ends, batch.column(batch.num_columns - 1).slice(a, b - a))
                raw, old = buf[offs[a] : offs[b]].tobytes(), col.slice(a, b - a).to_pylist()
                texts = []
                for i, text in enumerate(old):
                    x, y = ends[i], ends[i + 1]
                    lost = gone[x:y]
                    texts.append(text if text is None or not lost.any() else bytes(np.frombuffer(raw[x:y], np.uint8)[~lost]).decode("utf-8", "ignore"))
                cols = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                cols[place] = pa.array(texts, col.type)
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    return R.with_places(docs, repeated(docs, span)).mapInArrow(run, schema)


def brute(docs: list[tuple[int | None, str | None]], span: int = SPAN) -> list[tuple]:
    """The same figures by plain comparison, for tests."""
    first: dict[bytes, tuple] = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, x in raw:
        for i in range(len(x) - span + 1 if d is not None else 0):
            key = x[i : i + span]
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - span + 1 if d is not None else 0):
            if first[x[i : i + span]] < (d, i):
                gone[i : i + span] = b"\x01" * span
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
