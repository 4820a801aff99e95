"""Links in the values of JSON documents, and of JSON written inside their strings."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dredge.functions.columns import GITHUB_ASSETS, LOOSE_LINK
from dredge.functions.web_url import valid_loosely

_LOOSE = re.compile(LOOSE_LINK)
_GITHUB = [re.compile(x) for x in GITHUB_ASSETS]


def has_extension(url: str) -> bool:
    plain = re.split(r"[?#]", url, maxsplit=1)[0]
    if (plain.startswith("//") or "://" in plain) and plain.count("/") == 2:
        return False
    last = plain.rpartition("/")[2]
    return "." in last and not last.endswith(".")


def is_asset(url: str) -> bool:
    return has_extension(url) or ("github" in url and any(p.search(url) for p in _GITHUB))


def _walk(value: object, found: list[str], depth: int = 0) -> None:
    stack = [(value, depth)]
    while stack:
        v, d = stack.pop()
        if isinstance(v, dict):
            stack.extend((x, d) for x in reversed(v.values()))
        elif isinstance(v, list):
            stack.extend((x, d) for x in reversed(v))
        elif isinstance(v, str):
            if valid_loosely(v):
                found.append(v)
            elif v.lstrip()[:1] in ("{", "[") and d < 16:
                try:
                    stack.append((json.JSONDecoder().raw_decode(v.lstrip())[0], d + 1))
                except (ValueError, RecursionError):
                    found.extend(_LOOSE.findall(v))
            else:
                found.extend(_LOOSE.findall(v))


def extract(body: str) -> tuple[list[str], list[str], str | None]:
    """(assets, outlinks, error) of the first JSON document of a body."""
    try:
        value, _ = json.JSONDecoder().raw_decode(body.lstrip())
    except (ValueError, RecursionError) as e:
        return [], [], str(e)
    found: list[str] = []
    _walk(value, found)
    return [x for x in found if is_asset(x)], [x for x in found if not is_asset(x)], None


SPLIT = T.StructType([T.StructField("assets", T.ArrayType(T.StringType())), T.StructField("outlinks", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


@F.pandas_udf(SPLIT)
def json_links(body: pd.Series) -> pd.DataFrame:
    rows = [extract(x) if x else ([], [], "empty") for x in body]
    return pd.DataFrame(rows, columns=["assets", "outlinks", "error"])
