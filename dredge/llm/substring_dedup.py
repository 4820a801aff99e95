"""Substring dedup on words: winnowed seeds, extension both ways, maximal repeats over a length.

A word is a maximal run of bytes other than ASCII white space. A window is `span` consecutive words
of one document; it repeats if its words also start in a document with a smaller doc_id. The words
that repeated windows cover form the maximal repeats, which go; the earliest holder keeps its own.
Judged on the input, not on what is left. See `repeats` for the plan and for its bounds.

Null and empty texts have no words. Rows that repeat a doc_id are not earlier than one another. Rows
without doc_id are left whole. Extra columns are kept by `dedup` and ignored by `measure`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dredge.llm import kernel as K
from dredge.llm import repeats as R
from dredge.llm.common import gather, settle, strings

SPAN, GRAM = 13, 5


def unit(span: int = SPAN) -> R.Unit:
    return R.Unit(span=span, k=min(GRAM, span), words=True, within=False)


def repeated(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id -> places of repeated windows (a written table)."""
    u = unit(span)
    return R.covered_places(docs, u, R.hashed_windows(u))


def measure(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space) of every row."""
    u = unit(span)
    rows = R.with_places(docs.select("doc_id", "text"), repeated(docs, span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.column_bytes(batch.column(1))
            for a, b in K.blocks(offs):
                raw, rows = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                starts, stops, words = K.word_spans(raw, rows, K.SPACES)
                gone = R.removal(u, raw, rows, words, batch.column(2).slice(a, b - a))
                kept = np.flatnonzero(~gone)
                data, ends = gather(np.append(raw, np.uint8(32)), starts[kept], (stops - starts)[kept] + 1)
                data[ends[1:] - 1] = 32
                cut = ends[np.searchsorted(kept, words)]
                raw = data.tobytes()
                digests = [hashlib.sha256(raw[x : max(x, y - 1)]).hexdigest() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                removed = np.diff(np.append(0, np.cumsum(gone))[words])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(np.diff(words)), pa.array(removed), pa.array(digests, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs with the repeats cut out of text: white space before kept words stays as it was.

    All columns stay; n_chars, if there is one, is counted anew where text has changed.
    """
    u = unit(span)
    place, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(place)
            buf, offs = K.column_bytes(col)
            for a, b in K.blocks(offs):
                raw, rows = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                starts, _, words = K.word_spans(raw, rows, K.SPACES)
                gone = R.removal(u, raw, rows, words, batch.column(batch.num_columns - 1).slice(a, b - a))
                old = col.slice(a, b - a)
                if gone.any():
                    keep = np.ones(len(raw), bool)
                    row_end = rows[np.searchsorted(words, np.arange(len(gone)), "right")]
                    after = np.minimum(np.append(starts[1:], len(raw)), row_end)
                    keep[K.covered(len(raw), starts[gone], after[gone])] = False
                    counts = np.append(0, np.cumsum(keep))[rows]
                    new = strings(raw[keep], counts)
                    texts = pa.array([None if o is None else n for o, n in zip(old.to_pylist(), new.to_pylist(), strict=True)], pa.string())
                else:
                    texts = old
                cols = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                cols[place] = texts.cast(col.type)
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])
        settle()

    out = R.with_places(docs, repeated(docs, span)).mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(schema["n_chars"].dataType), "n_chars")).select(docs.columns)
    return out


def brute(docs: list[tuple[int | None, str | None]], span: int = SPAN) -> list[tuple]:
    """The same figures by plain comparison, for tests."""
    parts = [(d, "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ")) for d, t in docs]
    parts = [(d, [w for w in ws if w]) for d, ws in parts]
    first: dict[tuple, int] = {}
    for d, ws in parts:
        for i in range(len(ws) - span + 1):
            key = tuple(ws[i : i + span])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, ws in parts:
        gone = set()
        for i in range(len(ws) - span + 1):
            if d is not None and first[tuple(ws[i : i + span])] < d:
                gone.update(range(i, i + span))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
