"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is cut into windows of WINDOW bytes (the last padded with zeros). In a window every byte has
an embedding; filters of several widths slide over it; each filter's maximum over the window passes a
rectifier; a linear layer and a softmax give the languages. A text's languages are the mean of its
windows' log probabilities, weighted by their bytes, so the whole text counts.

Applied, the first layer is a table: filter tap times embedding, for each tap and byte value, so a
filter costs a lookup and a sum per tap. Trained by Adam on windows from a bounded sample: about
TRAIN_ROWS documents per language, TRAIN_MOST in all, TRAIN_BYTES bytes. The languages are those of the
sample. The model's size follows their number.

`und` stands for null and empty text and text without any letter, with score 0. Without rows to learn
from, as of an empty table, all is `und`. Texts of any length are judged whole, a window at a time. Rows
that repeat a doc_id are judged each by its text; rows without doc_id are judged but not learned from.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dredge.llm import kernel as K
from dredge.llm.common import written
from dredge.llm.labelled import bounded_sample, held_out

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
TRAIN_ROWS, TRAIN_MOST, TRAIN_BYTES = 400, 40_000, 16 << 20
STEPS, BATCH = 500, 128

_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: For each width and tap: (256, FILTERS) values of tap times embedding.
    taps: tuple[tuple[np.ndarray, ...], ...]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _convolve(windows: np.ndarray, taps: tuple[np.ndarray, ...]) -> np.ndarray:
    """(windows, places, FILTERS) responses of the filters of one width."""
    n = windows.shape[1] - len(taps) + 1
    total = taps[0][windows[:, :n]]
    for j in range(1, len(taps)):
        total += taps[j][windows[:, j : j + n]]
    return total


def log_probabilities(model: Model, windows: np.ndarray) -> np.ndarray:
    pooled = np.concatenate([_convolve(windows, t).max(1) for t in model.taps], 1)
    z = np.maximum(pooled + model.bias, 0) @ model.out + model.out_bias
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, row of each, bytes in each); rows without bytes have none."""
    size = np.diff(offs)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(n)), n)
    start = offs[row] + (np.arange(len(row)) - (np.cumsum(n) - n)[row]) * WINDOW
    have = np.minimum(WINDOW, offs[row + 1] - start)
    place = np.arange(WINDOW)
    padded = np.append(buf, np.zeros(WINDOW, np.uint8))
    out = padded[start[:, None] + place]
    short = np.flatnonzero(have < WINDOW)
    out[short] = np.where(place < have[short, None], out[short], 0)
    return out, row, have


def fit(sample: list[tuple[str, str]], steps: int = STEPS, batch: int = BATCH) -> Model | None:
    """Train on windows of the sample; every language has the same share of each batch."""
    languages = tuple(sorted({label for _, label in sample}))
    if not languages:
        return None
    rng = np.random.default_rng(5)
    buf, offs = K.column_bytes(pa.array([t for t, _ in sample], pa.large_string()))
    windows, row, have = windows_of(buf, offs)
    label = np.array([languages.index(x) for _, x in sample])[row]
    usable = have >= min(32, int(have.max(initial=0)))
    by_language = [x for x in (np.flatnonzero((label == i) & usable) for i in range(len(languages))) if len(x)]
    scale = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    total = FILTERS * len(WIDTHS)
    p = {"emb": scale(256, EMBED) * 0.5, "bias": np.zeros(total, np.float32), "out": scale(total, len(languages)) * 0.2, "out_bias": np.zeros(len(languages), np.float32)}
    for w in WIDTHS:
        p[f"w{w}"] = scale(w, EMBED, FILTERS) / np.float32(np.sqrt(w * EMBED))
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    tables = lambda: tuple(tuple(p["emb"] @ p[f"w{w}"][j] for j in range(w)) for w in WIDTHS)
    for step in range(1, steps + 1):
        if not by_language:
            break
        pick = np.concatenate([rng.choice(x, -(-batch // len(by_language))) for x in by_language])
        x, y = windows[pick], label[pick]
        # A random cut of the window teaches short texts as well.
        cut = rng.integers(24, WINDOW + 1, len(pick))
        x = np.where(np.arange(WINDOW) < cut[:, None], x, 0)
        n = np.arange(len(pick))[:, None]
        best, value = [], []
        for taps in tables():
            r = _convolve(x, taps)
            a = r.argmax(1)
            best.append(a)
            value.append(np.take_along_axis(r, a[:, None], 1)[:, 0])
        pooled = np.concatenate(value, 1) + p["bias"]
        hidden = np.maximum(pooled, 0)
        z = hidden @ p["out"] + p["out_bias"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(len(y)), y] -= 1
        q /= len(y)
        dh = (q @ p["out"].T) * (pooled > 0)
        g = {"out": hidden.T @ q, "out_bias": q.sum(0), "bias": dh.sum(0), "emb": np.zeros_like(p["emb"])}
        for i, w in enumerate(WIDTHS):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            gw = np.zeros_like(p[f"w{w}"])
            for j in range(w):
                at = x[n, best[i] + j]
                gw[j] = np.einsum("nf,nfe->ef", d, p["emb"][at])
                np.add.at(g["emb"], at, d[..., None] * p[f"w{w}"][j].T[None])
            g[f"w{w}"] = gw
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(languages, tables(), p["bias"], p["out"], p["out_bias"])


def train(docs: DataFrame) -> Model | None:
    """Fit on a bounded sample of rows with text and language that aren't held out."""
    known = docs.where("doc_id is not null and text is not null and lang is not null").where(~held_out())
    # Per language a share by hash, so that about TRAIN_ROWS of each remain.
    shares = written(known.groupBy("lang").agg((F.lit(float(TRAIN_ROWS)) / F.count("*")).alias("share")), "shares")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < F.least("share", F.lit(1.0)) * (1 << 30)
    labels = known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").join(shares, "lang").where(drawn)
    labels = labels.groupBy("doc_id").agg(F.min("lang").alias("label"))
    return fit(bounded_sample(docs, labels, TRAIN_MOST, TRAIN_BYTES))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row: one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, offs = K.column_bytes(text)
        best, sure = np.zeros(len(text), np.int64), np.zeros(len(text))
        for a, b in K.blocks(offs, 1 << 20):
            total = np.zeros((b - a, len(model.languages)))
            windows, row, have = windows_of(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            for i in range(0, len(windows), 512):
                j = slice(i, i + 512)
                part = log_probabilities(model, windows[j]) * have[j, None]
                np.add.at(total, row[j], part)
            total /= np.maximum(np.diff(offs[a : b + 1]), 1)[:, None]
            q = np.exp(total - total.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            best[a:b], sure[a:b] = q.argmax(1), q.max(1)
        return best, sure

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            known = [bool(t) and _LETTER.search(t) is not None for t in texts]
            if model is None:
                lang, sure = ["und"] * len(texts), [0.0] * len(texts)
            else:
                best, p = judge(model, batch.column(2))
                lang = [model.languages[i] if k else "und" for i, k in zip(best, known, strict=True)]
                sure = [float(x) if k else 0.0 for x, k in zip(p, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
