"""Links of HTML pages from standard-library parser events: outlinks, assets, base and charset.

One pass per page gives all of it, so the markup is parsed once. Values are as written; resolution
against the base happens in the same pass by RFC 3986.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dredge.functions import css_links, json_links, web_url
from dredge.functions.columns import QUOTED_LINK, STRICT_LINK

#: Attributes of anchors that hold outlinks, attributes and path parts of anchors that are assets.
OUTLINK_ATTRIBUTES = ("href", "data-href", "data-url", "data-link", "data-redirect-url", "ping", "onclick", "ondblclick", "router-link", "to")
ASSET_ATTRIBUTES = ("href", "data-href", "data-src", "data-srcset", "data-lazy-src", "src", "srcset")
ASSET_PARTS = ("static/", "assets/", "asset/", "images/", "image/", "img/")
_LOCATION = re.compile(r"window\.location(?:\.href)?\s*=\s*['\"]([^'\"]+)['\"]", re.I)
_CONTENT_URL = re.compile(r"\burl\s*=\s*(\S+)", re.I)
_STRICT, _QUOTED = regex.compile(STRICT_LINK), re.compile(QUOTED_LINK)
#: What may follow a backslash in a quoted literal.
_LITERAL = re.compile(r"\\(?:([abfnrtv\\\"])|x([0-9a-fA-F]{2})|([0-7]{3})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8}))|(\\|[\"\n])")
_NAMED = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"'}


def _srcset(value: str) -> list[str]:
    return [part.split()[0] for part in value.split(",") if part.split()]


def unquote(text: str) -> str | None:
    """What a double-quoted literal with this content means; null if it can't be one."""
    if not any(c in text for c in '\\"\n'):
        return text
    bad = False

    def meant(m: re.Match) -> str:
        nonlocal bad
        if m[6]:
            bad = True
            return ""
        code = int(m[2] or m[4] or m[5], 16) if m[2] or m[4] or m[5] else int(m[3], 8) if m[3] else None
        if code is not None and (code > 0x10FFFF or 0xD800 <= code < 0xE000):
            bad = True
            return ""
        return _NAMED[m[1]] if code is None else chr(code)

    done = _LITERAL.sub(meant, text)
    return None if bad else done


def script_json(text: str) -> str | None:
    """The brace-balanced object after the first equals sign of a script, if there is one."""
    _, mark, rest = text.partition("=")
    start = rest.find("{")
    if not mark or start < 0:
        return None
    depth, quoted, skip = 0, "", False
    for i in range(start, len(rest)):
        c = rest[i]
        if skip:
            skip = False
        elif c == "\\" and quoted:
            skip = True
        elif quoted:
            quoted = "" if c == quoted else quoted
        elif c in "\"'":
            quoted = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return rest[start : i + 1]
    return None


class _Links(HTMLParser):
    def __init__(self, disabled: frozenset[str], alternates: bool, strict: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.disabled, self.alternates, self.strict = disabled, alternates, strict
        self.outlinks: list[tuple[str, str]] = []
        self.assets: list[tuple[str, str]] = []
        self.imports: list[tuple[str, str]] = []
        self.base: str | None = None
        self.text: list[str] | None = None
        self.script: dict[str, str] = {}
        self.opened = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "base" and self.base is None and "href" in a:
            self.base = a["href"].strip(" \t\n\f\r")
        if tag not in self.disabled:
            self._outlinks(tag, a)
        if tag in ("script", "style"):
            self.text, self.script, self.opened = [], a, self.get_starttag_text() or ""
        add = lambda v: self.assets.append((tag, v)) if v else None
        if "data-item" in a:
            self._json(tag, a["data-item"])
        if "style" in a:
            for link in css_links.extract(a["style"], inline=True)[0]:
                add(link)
        if a.get("data-preview", "").startswith("http"):
            add(a["data-preview"])
        if tag in self.disabled:
            return
        if tag == "a":
            for name in ASSET_ATTRIBUTES:
                value = a.get(name, "")
                if any(part in value for part in ASSET_PARTS):
                    add(value)
        elif tag == "img":
            for name in ("src", "data-src", "data-lazy-src"):
                add(a.get(name, ""))
            for name in ("srcset", "data-srcset"):
                for v in _srcset(a.get(name, "")):
                    add(v)
        elif tag in ("video", "audio", "embed"):
            add(a.get("src", ""))
        elif tag == "link":
            if self.alternates or a.get("rel") != "alternate":
                add(a.get("href", ""))
        elif tag == "meta":
            add(a.get("href", ""))
            content = a.get("content", "")
            found = _CONTENT_URL.search(content)
            if found:
                add(found[1].strip("'\""))
            elif _STRICT.search(content):
                add(content)
        elif tag == "source":
            add(a.get("src", ""))
            for v in _srcset(a.get("srcset", "")):
                add(v)
        elif tag == "div":
            add(a.get("data-src", ""))
            for v in _srcset(a.get("data-srcset", "")):
                add(v)
        elif tag == "replay-web-page":
            add(a.get("source", ""))
        elif tag == "script":
            add(a.get("src", ""))

    handle_startendtag = handle_starttag

    def _outlinks(self, tag: str, a: dict[str, str]) -> None:
        if tag == "a":
            for name in OUTLINK_ATTRIBUTES:
                value = a.get(name, "")
                if name.startswith("on"):
                    found = _LOCATION.search(value)
                    value = found[1] if found else ""
                if value:
                    self.outlinks.append((tag, value))
        elif tag == "iframe" and a.get("src"):
            self.outlinks.append((tag, a["src"]))
        elif tag == "area" and a.get("href"):
            self.outlinks.append((tag, a["href"]))

    def _json(self, tag: str, text: str) -> None:
        assets, _, error = json_links.extract(text)
        if not error:
            self.assets.extend((tag, x) for x in assets)

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if self.text is None or tag not in ("script", "style"):
            return
        text, self.text = "".join(self.text), None
        if tag in self.disabled:
            return
        if tag == "style":
            links, imports = css_links.extract(text, inline=False)
            for link in links:
                if link.startswith("#wp-"):
                    continue
                self.assets.append((tag, link if "http" in link else re.sub(r"^//", "http://", link)))
            self.imports.extend((tag, x) for x in imports)
            return
        if "json" in self.script.get("type", ""):
            self._json(tag, text)
        outer = f"{self.opened}{text}</script>"
        for link in dict.fromkeys(m[0] for m in _STRICT.finditer(outer)) if self.strict else dict.fromkeys(_QUOTED.findall(outer)):
            plain = unquote(link) if link.startswith("http") else None
            if plain is not None:
                self.assets.append((tag, plain))
        if not text.startswith("{"):
            body = script_json(text)
            if body:
                self._json(tag, body)


def extract(html: str, page: str, disabled: frozenset[str] = frozenset(), alternates: bool = False, strict: bool = False, charset: str | None = None) -> Iterator[tuple[str, str, str]]:
    """(url, kind, tag) of every link, resolved; kind is outlink, asset or import.

    Queries are written in the page's charset, if one is given. strict: scripts are searched with the strict pattern.
    """
    parser = _Links(disabled, alternates, strict)
    parser.feed(html)
    parser.close()
    base = None
    if parser.base and not re.match(r"(data|javascript|vbscript):", parser.base, re.I):
        base = web_url.resolve(parser.base, page)
    for kind, found in (("outlink", parser.outlinks), ("asset", parser.assets), ("import", parser.imports)):
        for tag, raw in found:
            url = web_url.resolve(raw.strip(), page, base)
            if url and not (kind == "outlink" and url in (page, base) and raw.strip() != url):
                yield web_url.reencode_query(url, charset) if charset else url, kind, tag


LINKS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("url", "kind", "tag")]))


def html_links(html: Column, page: Column, disabled: tuple[str, ...] = (), alternates: bool = False, strict: bool = False, charset: Column | None = None) -> Column:
    """Array of (url, kind, tag) of each page."""
    off = frozenset(disabled)

    @F.pandas_udf(LINKS)
    def run(bodies: pd.Series, pages: pd.Series, charsets: pd.Series) -> pd.Series:
        rows = zip(bodies, pages, charsets, strict=True)
        return pd.Series([[{"url": u, "kind": k, "tag": t} for u, k, t in extract(b, p, off, alternates, strict, c)] if b and p else [] for b, p, c in rows])

    return run(html, page, F.lit(None).cast("string") if charset is None else charset)


#: Labels that stand for another encoding, as browsers have it.
_ALIASES = {"iso-8859-1": "windows-1252", "iso8859-1": "windows-1252", "latin1": "windows-1252", "ascii": "windows-1252", "us-ascii": "windows-1252", "gb2312": "gbk", "utf8": "utf-8"}
_META = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-:]+)", re.I)


def detect_charset(body: bytes, content_type: str | None) -> str:
    """Byte order mark, then header, then meta in the first 1024 bytes, then whether it is UTF-8."""
    import codecs

    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if body.startswith(mark):
            return name
    header = re.search(r"charset\s*=\s*[\"']?([A-Za-z0-9_\-:]+)", content_type or "", re.I)
    meta = None if header else _META.search(body[:1024])
    for found in (header and header[1], meta and meta[1].decode("ascii")):
        if found:
            name = _ALIASES.get(found.lower(), found.lower())
            try:
                codecs.lookup(name)
                return name
            except LookupError:
                pass
    try:
        return "utf-8" if not body[:1024].isascii() and body.decode("utf-8") else "windows-1252"
    except UnicodeDecodeError:
        return "windows-1252"


@F.pandas_udf(T.StructType([T.StructField("charset", T.StringType()), T.StructField("text", T.StringType())]))
def decode_body(body: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    """Charset of each body and its text."""
    out = []
    for b, c in zip(body, content_type, strict=True):
        if b is None:
            out.append((None, None))
            continue
        name = detect_charset(bytes(b), c)
        out.append((name, bytes(b).decode({"windows-1252": "cp1252"}.get(name, name), "replace")))
    return pd.DataFrame(out, columns=["charset", "text"])
