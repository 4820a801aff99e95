"""URL parsing in the manner of browsers, for http and https, and RFC 3986 resolution.

The JVM's URI class refuses what browsers accept, so raw links go through this parser once, in an
Arrow UDF; what comes out is ASCII and safe for the native functions of `columns`.

Deviations from the living standard: other schemes are recognised but not parsed further; IDNA uses
the `idna` package if it can be imported, else the standard library's 2003 codec; query keys keep
the order of their first appearance when a query is encoded again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import idna
except ImportError:
    idna = None

#: The error classes of normalisation.
UNSUPPORTED_SCHEME, UNSUPPORTED_HOST, TOO_LONG, PATH_LOOP, UNPARSABLE = "unsupported_scheme", "unsupported_host", "url_too_long", "path_loop", "unparsable"
#: Hosts whose signed queries stay as they are.
SIGNED_HOSTS = ("external-preview.redd.it", "preview.redd.it", "styles.redditmedia.com")

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_PORTS = {"http": 80, "https": 443}
_C0 = "".join(map(chr, range(33)))
_FORBIDDEN = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")


@dataclass
class Url:
    scheme: str
    user: str
    host: str
    port: int | None
    path: str
    query: str | None

    @property
    def authority(self) -> str:
        return self.host + (f":{self.port}" if self.port is not None else "")

    @property
    def href(self) -> str:
        user = f"{self.user}@" if self.user else ""
        return f"{self.scheme}://{user}{self.authority}{self.path}" + (f"?{self.query}" if self.query is not None else "")


def _encode(text: str, unsafe: str) -> str:
    """Percent-encode controls, what isn't ASCII, and the given characters."""
    out = []
    for c in text:
        if "\x20" < c < "\x7f" and c not in unsafe:
            out.append(c)
        else:
            out.extend(f"%{b:02X}" for b in c.encode("utf-8", "replace"))
    return "".join(out)


def _ipv4(host: str) -> str | None:
    """Dotted quad of a host whose last label is a number; ValueError if it is no address; None otherwise."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if not re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", parts[-1]):
        return None
    numbers = []
    for p in parts:
        base = 16 if p[:2] in ("0x", "0X") else 8 if len(p) > 1 and p[0] == "0" else 10
        digits = p[2:] if base == 16 else p
        numbers.append(int(digits or "0", base))
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError("bad address")
    value = numbers[-1] + sum(n << (8 * (3 - i)) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def parse_host(raw: str) -> str:
    """ASCII form of a host; ValueError if there is none."""
    if raw.startswith("["):
        import ipaddress

        if not raw.endswith("]"):
            raise ValueError("bad address")
        return f"[{ipaddress.IPv6Address(raw[1:-1])}]"
    host = unquote_to_bytes(raw).decode("utf-8", "replace").lower()
    if not host.isascii():
        host = idna.encode(host, uts46=True).decode() if idna else host.encode("idna").decode()
    if not host or _FORBIDDEN.search(host):
        raise ValueError("bad host")
    return _ipv4(host) or host


def _dots(path: str) -> str:
    """Path with dot segments resolved."""
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        low = p.lower().replace("%2e", ".")
        last = i == len(parts) - 1
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(p)
    return "/" + "/".join(out)


def parse(raw: str, base: Url | None = None) -> Url:
    """Parse an http(s) URL, or a reference relative to base; ValueError if that can't be done."""
    text = re.sub(r"[\t\n\r]", "", raw.strip(_C0)).partition("#")[0]
    match = _SCHEME.match(text)
    if match:
        scheme, rest = match[1].lower(), text[match.end() :]
        if scheme not in _PORTS:
            return Url(scheme, "", "", None, rest, None)
        if base is None or scheme != base.scheme or rest[:1] in "/\\":
            return _special(scheme, rest.lstrip("/\\"))
        text = rest
    elif base is None:
        raise ValueError("relative without base")
    head, mark, query = text.partition("?")
    head = head.replace("\\", "/")
    if head.startswith("//"):
        return _special(base.scheme, text.lstrip("/\\"))
    coded = _encode(query, " \"#<>'") if mark else None
    if not head:
        return Url(base.scheme, base.user, base.host, base.port, base.path, coded if mark else base.query)
    path = head if head.startswith("/") else base.path.rpartition("/")[0] + "/" + head
    return Url(base.scheme, base.user, base.host, base.port, _dots(_encode(path, ' "#<>?^`{}')), coded)


def _special(scheme: str, rest: str) -> Url:
    end = re.search(r"[/\\?]", rest)
    place = end.start() if end else len(rest)
    user, _, hostport = rest[:place].rpartition("@")
    host, port = hostport, None
    found = re.fullmatch(r"(\[.*\]|[^:]*):([0-9]*)", hostport)
    if found:
        host = found[1]
        if found[2]:
            port = int(found[2])
            if port > 65535:
                raise ValueError("bad port")
            port = None if port == _PORTS[scheme] else port
    elif ":" in hostport and not hostport.startswith("["):
        raise ValueError("bad port")
    path, mark, query = rest[place:].partition("?")
    path = path.replace("\\", "/") or "/"
    return Url(scheme, _encode(user, " \"#<>?`{}/;=@[\\]^|"), parse_host(host), port, _dots(_encode(path, ' "#<>?^`{}')), _encode(query, " \"#<>'") if mark else None)


def has_loop(path: str, query: str, repetition: int = 3, threshold: int = 2) -> bool:
    from collections import Counter

    repetition, threshold = (repetition if repetition > 0 else 3), (threshold if threshold > 0 else 2)
    segments = Counter(x for x in path.split("/") if x)
    pairs = Counter(x for x in query.split("&") if x)
    if any(n > repetition for n in (*segments.values(), *pairs.values())):
        return True
    return sum(segments.values()) >= 10 and sum(n >= repetition for n in segments.values()) >= threshold


def form_encode(query: str) -> str:
    """Keys and values decoded and encoded again as forms do, keys in order of first appearance."""
    found: dict[str, list[str]] = {}
    for pair in query.split("&"):
        if not pair or ";" in pair:
            continue
        key, _, value = pair.partition("=")
        if re.search(r"%(?![0-9A-Fa-f]{2})", pair):
            continue
        found.setdefault(key.replace("+", " "), []).append(value.replace("+", " "))
    code = lambda x: "".join(chr(b) if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "-_.~") else "+" if b == 32 else f"%{b:02X}" for b in unquote_to_bytes(x))
    return "&".join(f"{code(k)}={code(v)}" for k, vs in found.items() for v in vs)


def to_string(raw: str) -> str:
    """A URL with its host in ASCII and its query encoded again, but for the signed hosts."""
    head, mark, fragment = raw.partition("#")
    match = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?.*)?$", head, re.S)
    if not match:
        return raw
    scheme, authority, path, query = match[1], match[2], match[3], match[4] or ""
    user, at, hostport = authority.rpartition("@")
    host, colon, port = hostport.partition(":") if not hostport.startswith("[") else (hostport, "", "")
    if not host.isascii():
        try:
            host = idna.encode(host.lower(), uts46=True).decode() if idna else host.encode("idna").decode()
        except (UnicodeError, ValueError):
            pass
    if query[1:] and host not in SIGNED_HOSTS:
        query = "?" + form_encode(query[1:])
    out = f"{scheme.lower()}://{user}{at}{host}{colon}{port}{_encode(path, ' \"<>^`{}|') if path else ''}{query}"
    return out + mark + (_encode(fragment, ' "<>`') if fragment else "")


def normalize(raw: str | None, parent: str | None = None, max_length: int = 4000, repetition: int = 3, threshold: int = 2) -> tuple[str | None, str | None]:
    """(url, error): an absolute http(s) URL without fragment, or the class of what is wrong with it."""
    text = (raw or "").strip("\"'")
    if re.search(r"[\x00-\x1f\x7f]", text) or re.match(r"\s", text):
        return None, UNPARSABLE
    try:
        match = _SCHEME.match(text)
        if parent and not match:
            base = parse(parent)
            if text.startswith("/"):
                base = Url(base.scheme, "", base.host, base.port, "/", None)
            url = parse(text, base)
        else:
            # Without a scheme http is assumed, for a host as well as for a bare path.
            url = parse(to_string(text) if match else to_string("http://" + text.lstrip("/")))
    except (ValueError, UnicodeError):
        return None, UNPARSABLE
    if url.scheme not in _PORTS:
        return None, UNSUPPORTED_SCHEME
    if url.host in ("localhost", "127.0.0.1") or "." not in url.host:
        return None, UNSUPPORTED_HOST
    href = url.href
    if len(href.encode()) > max_length:
        return None, TOO_LONG
    if has_loop(url.path, url.query or "", repetition, threshold):
        return None, PATH_LOOP
    return href, None


def resolve(raw: str, page: str, base: str | None = None) -> str | None:
    """Absolute form of a link by RFC 3986: an absolute one stays, the fragment stays."""
    if re.search(r"[\x00-\x1f\x7f]", raw):
        return None
    if _SCHEME.match(raw):
        return raw
    if ":" in raw.partition("/")[0].partition("?")[0].partition("#")[0]:
        return None
    match = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?", base or page)
    if not match:
        return None
    scheme, authority, path, query = match[1], match[2], match[3], match[4] or ""
    head, mark, fragment = raw.partition("#")
    tail = mark + fragment
    target, qmark, own = head.partition("?")
    if target.startswith("//"):
        return f"{scheme}:{raw}"
    if target:
        full = target if target.startswith("/") else (path.rpartition("/")[0] + "/" if "/" in path or authority is not None else "") + target
        path, query = _dots(full if full.startswith("/") else "/" + full), qmark + own
    elif qmark:
        query = qmark + own
    coded = _encode(path, ' "<>^`{}|')
    return f"{scheme}:" + (f"//{authority}" if authority is not None else "") + coded + query + tail


def valid_loosely(text: str) -> bool:
    """A scheme and a host, or a host followed by a path or query."""
    match = re.match(r"(?:([A-Za-z][A-Za-z0-9+.\-]*)://)?([^\s/?#:]+(?::[0-9]+)?)([/?].*)?$", text, re.S)
    if not match:
        return False
    return bool(match[1]) or ("." in match[2] and bool(match[3]))


@F.pandas_udf(T.StructType([T.StructField("url", T.StringType()), T.StructField("error", T.StringType())]))
def _normalize_udf(raw: pd.Series, parent: pd.Series, max_length: pd.Series, repetition: pd.Series, threshold: pd.Series) -> pd.DataFrame:
    rows = [normalize(r, p, m, n, t) for r, p, m, n, t in zip(raw, parent, max_length, repetition, threshold, strict=True)]
    return pd.DataFrame(rows, columns=["url", "error"])


def normalize_url(raw: Column, parent: Column | None = None, max_length: int = 4000, repetition: int = 3, threshold: int = 2) -> Column:
    """struct(url, error) of each raw link."""
    parent = F.lit(None).cast("string") if parent is None else parent
    return _normalize_udf(raw, parent, F.lit(max_length), F.lit(repetition), F.lit(threshold))


@F.pandas_udf(T.StringType())
def _resolve_udf(raw: pd.Series, page: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or p is None else resolve(r, p, b) for r, p, b in zip(raw, page, base, strict=True)], dtype=object)


def resolve_url(raw: Column, page: Column, base: Column | None = None) -> Column:
    return _resolve_udf(raw, page, F.lit(None).cast("string") if base is None else base)


@F.pandas_udf(T.StringType())
def url_to_string(raw: pd.Series) -> pd.Series:
    return raw.map(to_string, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def valid_url(text: pd.Series) -> pd.Series:
    return text.map(lambda x: bool(x) and valid_loosely(x)).astype("boolean")


def reencode_query(url: str, charset: str) -> str:
    """Query encoded in the page's charset, keys sorted; the path stays."""
    head, mark, query = url.partition("?")
    if not mark or charset.lower().replace("-", "") in ("utf8", ""):
        return url
    query, hash_, fragment = query.partition("#")
    pairs = []
    for pair in query.split("&"):
        key, eq, value = pair.partition("=")
        both = []
        for x in (key, value):
            raw = unquote_to_bytes(x.replace("+", " "))
            try:
                raw = raw.decode("utf-8").encode(charset, "strict")
            except (UnicodeError, LookupError):
                pass
            both.append("".join(chr(b) if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "-_.~") else "+" if b == 32 else f"%{b:02X}" for b in raw))
        pairs.append((both[0], both[1]))
    return head + "?" + "&".join(f"{k}={v}" for k, v in sorted(pairs, key=lambda p: p[0])) + hash_ + fragment


@F.pandas_udf(T.StringType())
def reencoded_query(url: pd.Series, charset: pd.Series) -> pd.Series:
    """URLs with their queries in a page's charset."""
    return pd.Series([None if u is None else reencode_query(u, c or "") for u, c in zip(url, charset, strict=True)], dtype=object)


def url_list(raw: Column) -> Column:
    """The raw links of an array that can be request targets: no white space, and brackets only in pairs."""
    return F.filter(raw, lambda x: x.isNotNull() & (x != "") & ~x.rlike(r"[\s\x00-\x1f\x7f]") & ((F.length(x) - F.length(F.replace(x, F.lit("["), F.lit("")))) == (F.length(x) - F.length(F.replace(x, F.lit("]"), F.lit(""))))))
