"""Targets of link annotations in PDF files: /URI strings in plain and in deflated objects."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_URI = re.compile(rb"/URI\s*\(((?:\\.|[^\\()])*)\)", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def extract(body: bytes) -> list[str]:
    parts = [body]
    for m in _STREAM.finditer(body):
        try:
            parts.append(zlib.decompressobj().decompress(m[1], 1 << 26))
        except zlib.error:
            continue
    found = []
    for part in parts:
        for m in _URI.finditer(part):
            raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1].isdigit() else _ESCAPES.get(e[1], e[1]), m[1], flags=re.S)
            found.append(raw.decode("latin-1"))
    return list(dict.fromkeys(found))


@F.pandas_udf(T.ArrayType(T.StringType()))
def pdf_links(body: pd.Series) -> pd.Series:
    """Links of each body, given as binary or as text in latin-1."""
    return pd.Series([extract(b.encode("latin-1", "ignore") if isinstance(b, str) else bytes(b)) if b is not None else [] for b in body])
