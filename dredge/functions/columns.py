"""URL and policy functions as Catalyst expressions: no Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes that links are never followed to; status codes that redirect.
SKIPPED_SCHEMES = ("data", "file", "javascript", "mailto", "sms", "tel")
REDIRECTS = (300, 301, 302, 303, 307, 308)
#: Link in running text, quoted link, and URLs of a code host that count as assets.
LOOSE_LINK = r"(?i)https?://[^<>'\",\s/]+\.[^<>'\",\s/]+(?:/[^<>'\",\s]*)?"
#: Strict form: letters, marks, numbers, symbols and punctuation, brackets only in pairs, no punctuation at the end.
_END, _MID = r"\p{L}\p{M}\p{N}/\-_+&~%=#\p{Sc}\p{So}", r"\p{L}\p{M}\p{N}/\-_+&~%=#\p{Sc}\p{So}*\p{Po}"
_PAIRED = "|".join(rf"\{a}[{_MID}]*(?:\{a}[{_MID}]*\{z}[{_MID}]*)*\{z}" for a, z in ("()", "[]", "{}"))
STRICT_LINK = rf"(?i)https?://(?:[{_MID}]|{_PAIRED})*(?:[{_END}]|{_PAIRED})"
QUOTED_LINK = r"['\"](https?://[^'\"]+)['\"]"
GITHUB_ASSETS = (
    r"(?i)^https://[a-z-]*\.?(?:githubusercontent|githubassets)\.com/",
    r"(?i)^https://github\.com/user-attachments/",
    r"(?i)https://github\.com/[^/]+/[^/]+/assets/",
)

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    """host[:port] as written."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def authority_host(at: Column) -> Column:
    """Host of an authority, without user and port, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(at, r"^.*@", ""), r":[0-9]*$", ""))


def hostname(url: Column) -> Column:
    """Host without user and port, in lower case."""
    return authority_host(authority(url))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    """Without the question mark."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def supported_scheme(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def supported_host(url: Column) -> Column:
    host = hostname(url)
    return ~host.isin("localhost", "127.0.0.1") & host.contains(".")


def too_long(url: Column, limit: int = 4000) -> Column:
    return F.octet_length(url) > limit


def _counts(parts: Column) -> Column:
    """How often each distinct non-empty part occurs."""
    parts = F.filter(parts, lambda x: x != "")
    return F.transform(F.array_distinct(parts), lambda x: F.size(F.filter(parts, lambda y: y == x)))


def path_loop(path_: Column, query_: Column, repetition: int = 3, threshold: int = 2) -> Column:
    """A path segment or query pair over `repetition` times; or, from ten segments on, `threshold` of them that often."""
    repetition, threshold = (repetition if repetition > 0 else 3), (threshold if threshold > 0 else 2)
    segments = F.split(path_, "/")
    counts, pairs = _counts(segments), _counts(F.split(query_, "&"))
    deep = F.size(F.filter(segments, lambda x: x != "")) >= 10
    return (
        F.exists(counts, lambda n: n > repetition)
        | F.exists(pairs, lambda n: n > repetition)
        | (deep & (F.size(F.filter(counts, lambda n: n >= repetition)) >= threshold))
    )


def has_file_extension(url: Column) -> Column:
    """The last path segment has a dot, not as its last character; a URL of a host alone has none."""
    plain = F.regexp_replace(url, r"(?s)[?#].*$", "")
    host_only = (plain.startswith("//") | plain.contains("://")) & (F.length(plain) - F.length(F.replace(plain, F.lit("/"), F.lit(""))) == 2)
    last = F.substring_index(plain, "/", -1)
    return ~host_only & last.contains(".") & ~last.endswith(".")


def reverse_host(hostport: Column) -> Column:
    """Labels in reverse order, lower case, no trailing dot, port kept; IP addresses stay."""
    port = F.regexp_extract(hostport, r"^[^:]*(:[0-9]+)$", 1)
    host = F.regexp_replace(hostport, r"^([^:]*):[0-9]+$", "$1")
    trimmed = F.regexp_replace(F.lower(host), r"\.$", "")
    is_ip = trimmed.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | hostport.startswith("[") | hostport.rlike(r":.*:")
    return F.when(is_ip, hostport).otherwise(F.concat(F.array_join(F.reverse(F.split(trimmed, r"\.")), "."), port))


def normalize_domain(domain: Column) -> Column:
    return F.regexp_replace(F.lower(domain), r"\.$", "")


def is_subdomain(host: Column, domain: Column) -> Column:
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain of it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def skipped_protocol(url: Column) -> Column:
    return F.lower(url).rlike("^(" + "|".join(SKIPPED_SCHEMES) + "):")


def is_redirect(status: Column) -> Column:
    return status.isin(*REDIRECTS)


def contains_any(text: Column, needles: list[str] | tuple[str, ...]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | text.contains(n)
    return found


def decode_hops(path_: Column) -> Column:
    """Hops are the number of L in the path of a queue row."""
    return F.regexp_count(path_, F.lit("L"))


def encode_hops(hops: Column) -> Column:
    return F.repeat(F.lit("L"), hops)


def glob(text: Column, pattern: str) -> Column:
    """Whole-string match where * is any text and ? any one character."""
    parts = (".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return text.rlike("(?s)^" + "".join(parts) + r"\z")


def short_id(item_id: Column, is_seed: Column) -> Column:
    five = F.substring(item_id, 1, 5)
    return F.when(is_seed, F.concat(F.lit("seed-"), five)).otherwise(F.concat(F.lit("asset-"), five))


def unescape_ampersands(url: Column) -> Column:
    """Remove `amp;` and decode; a text that can't be decoded stays."""
    plain = F.replace(url, F.lit("amp;"), F.lit(""))
    return F.coalesce(F.try_url_decode(plain), url)


def text_links(text: Column, strict: bool = False) -> Column:
    """Distinct links in running text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(STRICT_LINK if strict else LOOSE_LINK), F.lit(0)))


#: Bytes that end the scan of a body if one word has more, and the shortest word that can be a link.
WORD_BYTES, WORD_CHARS = 64 << 10, 10


def body_links(text: Column, strict: bool = False) -> Column:
    """Distinct links of a body, word by word: loosely only words with :// that aren't short; a huge word ends the scan."""
    words = F.split(text, r"\s+")
    huge = F.array_position(F.transform(words, lambda w: F.octet_length(w) > WORD_BYTES), True)
    words = F.when(huge > 0, F.slice(words, 1, (huge - 1).cast("int"))).otherwise(words)
    if strict:
        words = F.filter(words, lambda w: w.contains("://"))
    else:
        words = F.filter(words, lambda w: w.contains("://") & (F.length(w) >= WORD_CHARS))
    pattern = F.lit(STRICT_LINK if strict else LOOSE_LINK)
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, pattern, F.lit(0)))))


def quoted_links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(QUOTED_LINK), F.lit(1))


def link_header(value: Column) -> Column:
    """Targets of a Link header, whatever their relation."""
    parts = F.transform(F.split(value, ", "), lambda x: F.trim(F.element_at(F.split(x, ";"), 1)))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^<|>$", "")), lambda x: x != "")


def playlist_links(body: Column) -> Column:
    """URIs of a playlist: lines that aren't tags, and URI attributes of alternative media."""
    lines = F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x))
    plain = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    media = F.transform(F.filter(lines, lambda x: x.startswith("#EXT-X-MEDIA:")), lambda x: F.regexp_extract(x, r'URI="([^"]*)"', 1))
    return F.concat(plain, F.filter(media, lambda x: x != ""))


def github_asset(url: Column) -> Column:
    """Assets of a code host, many of which have no file extension."""
    matched = F.lit(False)
    for pattern in GITHUB_ASSETS:
        matched = matched | url.rlike(pattern)
    return url.contains("github") & matched


def mime_class(mime: Column) -> Column:
    """html, sitemap-able xml, json, css, playlist, pdf, text or other, of a content type."""
    m = F.lower(mime)
    return (
        F.when(m.contains("html"), "html").when(m.contains("json"), "json").when(m.contains("svg"), "other").when(m.contains("mpegurl"), "m3u8")
        .when(m.contains("xml"), "xml").when(m.contains("css"), "css").when(m.contains("pdf"), "pdf").when(m.startswith("text/"), "text").otherwise("other")
    )


def bad_code(status: Column) -> Column:
    return (status >= 500) | status.isin(408, 425, 429)


def discard_reason(status: Column, headers: Column, statuses: tuple[int, ...] = (429,), max_mib: int = 0) -> Column:
    """First reason to discard a response, or null: challenge pages, listed status codes, declared length."""
    mitigated = F.lower(F.element_at(headers, "cf-mitigated")) == "challenge"
    akamai = F.element_at(headers, "server") == "AkamaiGHost"
    reason = F.when((status == 403) & mitigated, "cloudflare").when((status == 403) & akamai, "akamai")
    if statuses:
        reason = reason.when(status.isin(*statuses), "status")
    if max_mib > 0:
        reason = reason.when(F.element_at(headers, "content-length").try_cast("long") > max_mib * 1024 * 1024, "length")
    return reason


def retryable(reason: Column, status: Column) -> Column:
    return F.coalesce(reason == "cloudflare", F.lit(False)) | bad_code(status)


def keeps_body(mime: Column) -> Column:
    """Bodies that links can be found in stay; others are dropped after archiving."""
    m = F.lower(mime)
    return m.startswith("text/") | m.rlike("json|xml|javascript|html|pdf|mpegurl")
