"""Links of XML bodies from a lenient token stream, the sitemap test, and object-store listings.

Tags need not balance. Attribute values that start with http, name space declarations included, and
character data that starts with http count; other character data is searched for links.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import parse_qsl, quote, quote_plus, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dredge.functions.columns import LOOSE_LINK
from dredge.functions.json_links import SPLIT, is_asset

#: What marks a sitemap; servers that list S3-like buckets; servers that list Azure containers.
SITEMAP_MARK = "sitemaps.org/schemas/sitemap/"
S3_SERVERS = ("AmazonS3", "WasabiS3", "UploadServer", "AliyunOSS")
AZURE_SERVERS = ("Windows-Azure-Blob", "Blob Service Version", "Azurite-Blob")

_TOKEN = re.compile(r"<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<(?P<other>[?!].*?)>|<(?P<tag>/?[^\s<>/=]+(?:\s[^<>]*?)?/?)>|(?P<text>[^<]+)|(?P<bad><)", re.S)
_ATTRIBUTE = re.compile(r"[^\s=\"'<>/]+\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)
_LOOSE = re.compile(LOOSE_LINK)


def extract(body: str, salvage: bool = False) -> tuple[list[str], list[str], str | None]:
    """(assets, outlinks, error). A broken token loses what was found, unless salvage is set."""
    if not body.strip():
        return [], [], "empty"
    found: list[str] = []
    error = None
    for m in _TOKEN.finditer(body):
        if m["bad"]:
            error = "broken token"
            break
        if m["tag"]:
            for pair in _ATTRIBUTE.finditer(m["tag"]):
                value = unescape(pair[1] if pair[1] is not None else pair[2])
                if value.startswith("http"):
                    found.append(value)
        elif m["text"] is not None or m["cdata"] is not None:
            text = m["cdata"] if m["text"] is None else unescape(m["text"])
            if text.startswith("http"):
                found.append(text)
            else:
                found.extend(dict.fromkeys(_LOOSE.findall(text)))
    if error and not salvage:
        found = []
    return [x for x in found if is_asset(x)], [x for x in found if not is_asset(x)], error


def is_sitemap(body: str) -> bool:
    """The mark in any token: text, comment, directive, instruction, element name or attribute."""
    return any(SITEMAP_MARK in unescape(m[0]) for m in _TOKEN.finditer(body))


@F.pandas_udf(T.BooleanType())
def sitemap_mark(body: pd.Series) -> pd.Series:
    """is_sitemap of each body."""
    return body.map(lambda x: bool(x) and is_sitemap(x)).astype("boolean")


@F.pandas_udf(SPLIT)
def xml_links(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(x) if x else ([], [], "empty") for x in body], columns=["assets", "outlinks", "error"])


def _values(body: str, tag: str) -> list[str]:
    return [unescape(x) for x in re.findall(rf"<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>", body)]


def _with_query(url: str, **changes: str) -> str:
    parts = urlsplit(url)
    pairs = dict(parse_qsl(parts.query, keep_blank_values=True)) | changes
    return urlunsplit(parts._replace(query="&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in sorted(pairs.items()))))


def listing(url: str, server: str, body: str) -> tuple[list[str], str | None]:
    """(outlinks, error) of a bucket or container listing: the next page, and files or prefixes."""
    parts = urlsplit(url)
    root = f"{parts.scheme}://{parts.netloc}"
    if any(x in server for x in AZURE_SERVERS):
        if "<EnumerationResults" not in body:
            return [], "not a listing"
        out = [_with_query(url, marker=m) for m in _values(body, "NextMarker") if m]
        container = root + parts.path.rstrip("/")
        return out + [f"{container}/{quote(n.lstrip('/'))}" for n in _values(body, "Name")], None
    if "<ListBucketResult" not in body:
        return [], "not a listing"
    entries = re.findall(r"<Contents>(.*?)</Contents>", body, re.S)
    files = [(next(iter(_values(e, "Key")), ""), int(next(iter(_values(e, "Size")), "0") or 0)) for e in entries]
    urls = [f"{root}/{quote(k)}" for k, size in files if k and size > 0]
    if dict(parse_qsl(parts.query)).get("list-type") != "2":
        return ([_with_query(url, marker=files[-1][0])] if files else []) + urls, None
    prefixes = [p for e in re.findall(r"<CommonPrefixes>(.*?)</CommonPrefixes>", body, re.S) for p in _values(e, "Prefix")]
    out = [_with_query(url, prefix=p) for p in prefixes] if prefixes else urls
    if "true" in _values(body, "IsTruncated"):
        out += [_with_query(url, **{"continuation-token": t}) for t in _values(body, "NextContinuationToken") if t]
    return out, None


@F.pandas_udf(T.ArrayType(T.StringType()))
def listing_links(url: pd.Series, server: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([listing(u, s or "", b)[0] if u and b else [] for u, s, b in zip(url, server, body, strict=True)])
