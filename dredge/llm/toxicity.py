"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's score is a logistic function of its words; the sentences' scores combine by noisy-or,
1 - prod(1 - p), to the document's. Only documents carry labels: the weights are fitted to the
likelihood of the noisy-or, by which the sentences that explain the label get the blame, and `locate`
returns them.

The fit takes a bounded sample of labelled rows (TRAIN_ROWS documents, TRAIN_BYTES bytes), in the
driver, in numpy. Its inputs are words and byte n-grams of the lower-cased text alone (n-grams know
inflected forms that the sample lacks). They are hashed to BUCKETS; the FEATURES buckets whose presence
differs most between the labels take part. The model is of fixed size.

Null and empty texts have no sentences and score the noisy-or of nothing, 0. Without labelled rows
every score is 0. A doc_id with several labels counts as toxic if one of them says so. Rows that
repeat a doc_id are scored each by its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dredge.llm import kernel as K
from dredge.llm.common import settle
from dredge.llm.labelled import bounded_sample, held_out

TRAIN_ROWS, TRAIN_BYTES = 6_000, 32 << 20
#: Texts of the sample that are parsed at a time.
CHUNK = 64
BUCKETS, FEATURES, GRAMS = 1 << 20, 4_096, (5, 6)
THRESHOLD = 0.3

_WORD_SEP = np.array([b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])
_STOP = K.separator_table(".!?\n")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


class Sentences:
    """Features of a block of texts, and its sentences.

    Sentences end at a full stop, exclamation mark, question mark, newline or text end; those without
    words don't count. seen: arrays of (bucket, byte) for words and for n-grams, each at its last byte.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray) -> None:
        low = K.lowered(buf)
        starts, ends, _ = K.word_spans(buf, offs, _WORD_SEP)
        sums = K.prefix_sums(K.byte_values(low))
        mask = np.uint64(BUCKETS - 1)
        self.seen = [((K.span_hash(sums, starts, ends) & mask).astype(np.int32), ends - 1)]
        first = np.zeros(len(buf) + 1, bool)
        first[offs] = True
        row = np.cumsum(first[:-1], dtype=np.int32)
        for n in GRAMS:
            bucket = (K.rolling_hash(sums, n) & mask).astype(np.int32)
            at = np.flatnonzero(row[n - 1 :] == row[: len(bucket)]) if len(bucket) else np.zeros(0, np.int64)
            self.seen.append((bucket[at], at + n - 1))
        begin = first[:-1].copy()
        begin[1:] |= _STOP[buf[:-1]]
        self.begins = np.flatnonzero(begin)
        self.of_byte = np.cumsum(begin, dtype=np.int32) - 1
        self.row = np.searchsorted(offs, self.begins, "right") - 1
        self.spoken = np.bincount(self.of_byte[ends - 1], minlength=len(self.begins)) > 0
        self.stops = np.append(self.begins[1:], len(buf))


def _scores(model: Model, s: Sentences, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Score of each sentence (0 without words) and noisy-or of each row."""
    if not len(s.begins):
        return np.zeros(0), np.zeros(n_rows)
    part = np.zeros(s.stops[-1])
    for bucket, at in s.seen:
        part[at] += model.weights[bucket]
    soft = np.where(s.spoken, np.logaddexp(0, np.add.reduceat(part, s.begins) + model.bias), 0)
    return 1 - np.exp(-soft), 1 - np.exp(-np.bincount(s.row, soft, minlength=n_rows))


def fit(sample: list[tuple[str, int]], steps: int = 150, rate: float = 0.15, decay: float = 2e-4) -> Model:
    """Maximum likelihood of the noisy-or by Adam on the whole sample, with weight decay."""
    y = np.array([label for _, label in sample], float)
    if not len(y) or not 0 < y.sum() < len(y):
        return Model(np.zeros(BUCKETS, np.float32), -30.0 if not y.sum() else 0.0)
    parts = range(0, len(sample), CHUNK)
    parsed = lambda i: Sentences(*K.column_bytes(pa.array([t for t, _ in sample[i : i + CHUNK]], pa.large_string())))
    # Presence of each bucket per document, by label; the most telling buckets take part.
    one, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i in parts:
        s = parsed(i)
        seen = np.unique(np.concatenate([s.row[s.of_byte[at]] * BUCKETS + bucket for bucket, at in s.seen]))
        one += np.bincount(seen % BUCKETS, y[i + seen // BUCKETS], minlength=BUCKETS)
        every += np.bincount(seen % BUCKETS, minlength=BUCKETS)
    expect = every * y.mean()
    chi = np.where(every >= 3, (one - expect) ** 2 / np.maximum(expect, 0.5), 0)
    chosen = np.argsort(-chi, kind="stable")[:FEATURES]
    index = np.full(BUCKETS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    feats, sents, rows, n_sent = [], [], [], 0
    for i in parts:
        s = parsed(i)
        number = np.cumsum(s.spoken) - 1
        for bucket, at in s.seen:
            part = (index[bucket] >= 0) & s.spoken[s.of_byte[at]]
            feats.append(index[bucket[part]])
            sents.append((number[s.of_byte[at[part]]] + n_sent).astype(np.int32))
        rows.append((s.row[s.spoken] + i).astype(np.int32))
        n_sent += int(s.spoken.sum())
    feature, sentence, row = np.concatenate(feats), np.concatenate(sents), np.concatenate(rows)
    if not n_sent:
        return Model(np.zeros(BUCKETS, np.float32), -30.0)
    w, b = np.zeros(len(chosen)), -5.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(sentence, w[feature], minlength=n_sent) + b
        total = np.bincount(row, np.logaddexp(0, z), minlength=len(y))
        p = np.clip(1 - np.exp(-total), 1e-9, 1)
        # d(-log likelihood)/dz is sigma(z) for label 0 and -sigma(z) (1 - p) / p for label 1.
        blame = np.where(y > 0, -(1 - p) / p, 1.0)[row] * np.exp(-np.logaddexp(0, -z))
        g = np.append(np.bincount(feature, blame[sentence], minlength=len(w)), blame.sum()) / len(y)
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(BUCKETS, np.float32)
    weights[chosen] = w
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample of labelled rows that aren't held out."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    return fit(bounded_sample(docs, known, TRAIN_ROWS, TRAIN_BYTES))


def _apply(model: Model, text: pa.Array) -> np.ndarray:
    buf, offs = K.column_bytes(text)
    out = np.zeros(len(text))
    for a, b in K.blocks(offs):
        out[a:b] = _scores(model, Sentences(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]), b - a)[1]
    return out


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _apply(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, with all their columns, that score under the threshold: one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_apply(shared.value, batch.column(place)) < threshold))
        settle()

    return docs.mapInArrow(run, docs.schema)


def locate(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and the byte range (start, stop) of every sentence that scores over the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.column_bytes(batch.column(1))
            ids = batch.column(0)
            for a, b in K.blocks(offs):
                s = Sentences(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                p = _scores(shared.value, s, b - a)[0]
                at = np.flatnonzero(p >= threshold)
                row = s.row[at] + a
                base = offs[row] - offs[a]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(p[at]), pa.array(s.begins[at] - base), pa.array(s.stops[at] - base)], ["doc_id", "score", "start", "stop"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, start long, stop long")
