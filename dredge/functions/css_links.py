"""Links of style sheets: url() values and strings, and @import rules where they are valid."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"/\*.*?(?:\*/|\Z)"
    r"|(?P<import>@import\b)"
    r"|(?P<at>@[A-Za-z-]+)"
    r"|(?P<func>url\(\s*(?=[\"']))"
    r"|(?P<url>url\(\s*(?P<plain>(?:\\[0-9A-Fa-f]{1,6}\s?|\\.|[^\\\"'()\s])*)\s*(?:\)|\Z))"
    r"|(?P<string>\"(?:\\.|[^\"\\\n])*(?:\"|\Z)|'(?:\\.|[^'\\\n])*(?:'|\Z))"
    r"|(?P<mark>[{};)])"
    r"|(?P<word>[^\s{};()\"'@/:,]+|.)",
    re.S | re.I,
)
_ESCAPE = re.compile(r"\\(?:([0-9A-Fa-f]{1,6})\s?|\n|(.))", re.S)


def unescape(text: str) -> str:
    """CSS escapes decoded; an escaped line end is nothing."""

    def one(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        return m[2] or ""

    return _ESCAPE.sub(one, text)


def _content(string: str) -> str:
    return unescape(string[1:-1] if len(string) > 1 and string[-1] == string[0] else string[1:])


def extract(css: str, inline: bool) -> tuple[list[str], list[str]]:
    """(links, imports). Imports count before other rules only; @charset and statement @layer may come first."""
    links: list[str] = []
    imports: list[str] = []
    valid, state, depth = not inline, "", 0
    in_url = False
    layer_between = False
    for m in _TOKEN.finditer(css):
        kind = m.lastgroup if m.lastgroup != "plain" else "url"
        text = m[0]
        if text.startswith("/*") or not text.strip():
            continue
        if m["import"]:
            state = "import" if valid and not depth else "skip"
        elif m["at"]:
            name = text.lower()
            state = "layer" if name == "@layer" else "charset" if name == "@charset" else "rule"
            if state == "rule":
                valid = False
        elif m["func"]:
            in_url = True
        elif m["url"] is not None or m["string"]:
            value = unescape(m["plain"]) if m["url"] is not None else _content(text)
            value = value.strip()
            if state == "import":
                if value and not layer_between:
                    imports.append(value)
                state = "imported"
            elif state not in ("skip", "imported", "charset") and (m["url"] is not None or in_url) and value:
                links.append(value)
            in_url = False
        elif kind == "mark":
            if text == "{":
                depth += 1
                valid = False
            elif text == "}":
                depth = max(0, depth - 1)
            elif text == ";":
                if state == "layer" and imports and not depth:
                    layer_between = True
                state = ""
            if text in "{}":
                state = ""
        elif not state:
            valid = False
    return links, imports


@F.pandas_udf(T.StructType([T.StructField("links", T.ArrayType(T.StringType())), T.StructField("imports", T.ArrayType(T.StringType()))]))
def css_links(css: pd.Series) -> pd.DataFrame:
    rows = [extract(x, False) if x else ([], []) for x in css]
    return pd.DataFrame(rows, columns=["links", "imports"])
