"""Substring and suffix dedup against brute force, with the awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from dredge.llm import repeats, substring_dedup, suffix_dedup


def corpus(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(30)]
    shared = [" ".join(rng.choices(words, k=rng.randint(14, 40))) for _ in range(6)]
    rows: list[tuple] = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(rng.randint(0, 5))]
        rows.append((i, "\n".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (None, shared[0]), (5, rows[5][1]), (7, shared[1]), (n + 3, "long " * 4000 + shared[2]), (-3, shared[3]), (n + 4, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
@pytest.mark.parametrize("hot", [1500, 1])
def test_against_brute_force(spark, monkeypatch, module, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("places", F.lit("x")).repartition(3)
    got = sorted(map(repr, (tuple(r) for r in module.measure(df).collect())))
    assert got == sorted(map(repr, module.brute(rows)))


def test_dedup_keeps_columns(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"a b {passage} c", "x", 0), (2, f"d\n{passage}\ne  f", "y", 0), (3, None, "z", 0), (4, "untouched  text\n", "t", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["source"], r["n_chars"]) for r in substring_dedup.dedup(df).collect()}
    assert got[1] == (rows[0][1], "x", len(rows[0][1])) and got[2] == ("d\ne  f", "y", 6) and got[3][0] is None and got[4][0] == "untouched  text\n"
    assert suffix_dedup.dedup(df, 30).count() == 4


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_empty(spark, module):
    assert module.measure(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bucket_pointer_refinement():
    import numpy as np

    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = np.arange(0, 3000)
    got = suffix_dedup.refine(buf, starts, 20, 3)
    raw = buf.tobytes()
    names: dict[bytes, set] = {}
    for s, p in zip(starts, got, strict=True):
        names.setdefault(raw[s : s + 20], set()).add(int(p))
    assert all(len(x) == 1 for x in names.values()) and len({next(iter(x)) for x in names.values()}) == len(names)
