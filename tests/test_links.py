"""Link extractors on small bodies."""

import zlib

from dredge.functions import css_links, html_links, json_links, pdf_links, xml_links

PAGE = "http://s.test/d/p"


def of(html, kind, **kw):
    return [u for u, k, _ in html_links.extract(html, PAGE, **kw) if k == kind]


def test_html_outlinks():
    html = """<a href="1"><a data-href="2"><a onclick="window.location.href='3'"><a ondblclick="window.location = '4'">
    <iframe src="5"></iframe><area href="6"><a href=""><a router-link="/7">"""
    assert of(html, "outlink") == [f"http://s.test/d/{i}" for i in range(1, 7)] + ["http://s.test/7"]


def test_base():
    assert of('<base href="/b/"><a href="x">', "outlink") == ["http://s.test/b/x"]
    assert of('<base href="data:x"><a href="x">', "outlink") == ["http://s.test/d/x"]


def test_html_assets():
    html = """<img src=a.png srcset="b.png 2x, c.png 3x" data-src=d.png><video src=e.mp4></video><link rel=stylesheet href=f.css>
    <link rel=alternate href=g><meta content="0; url='h'"><div data-srcset="i.png 1x"></div><source srcset="j.png">
    <p style="background:url(k.png)" data-preview="http://t.test/l" data-item='{"u":"http://t.test/m.js"}'></p><a href="/static/n.css">
    <style>@import "o.css"; x{background:url('//t.test/p.png')}</style><script src=q.js>var a = {"u": "http://t.test/r.js"}</script>"""
    got = of(html, "asset")
    for name in ("a.png", "b.png", "c.png", "d.png", "e.mp4", "f.css", "h", "i.png", "j.png", "k.png", "q.js"):
        assert f"http://s.test/d/{name}" in got, name
    for url in ("http://t.test/l", "http://t.test/m.js", "http://s.test/static/n.css", "http://t.test/p.png", "http://t.test/r.js"):
        assert url in got, url
    assert "http://s.test/d/g" not in got and "http://s.test/d/g" in of(html, "asset", alternates=True)
    assert of(html, "import") == ["http://s.test/d/o.css"]
    assert "http://s.test/d/a.png" not in of(html, "asset", disabled=frozenset({"img"}))


def test_css():
    assert css_links.extract("a{background:url(x.png)} b{src:url('y z.woff')}", False) == (["x.png", "y z.woff"], [])
    assert css_links.extract('@charset "utf-8"; @import url(a.css); @import "b.css" screen; p{} @import "late.css";', False)[1] == ["a.css", "b.css"]
    assert css_links.extract('@import "a.css"; b{background:url(c)}', True) == (["c"], [])
    assert css_links.extract("/* url(no) */ a{b:url( yes ", False)[0] == ["yes"]
    assert css_links.extract('@import "a.css"; @layer x; @import "b.css";', False)[1] == ["a.css"]


def test_json():
    assets, outlinks, error = json_links.extract('{"a": "http://s.test/x.js", "b": ["see http://s.test/y now", "{\\"c\\": \\"http://s.test/z\\"}"], "http://key.test/": 1}')
    assert (assets, sorted(outlinks), error) == (["http://s.test/x.js"], ["http://s.test/y", "http://s.test/z"], None)
    assert json_links.extract("nothing")[2] and json_links.extract("")[2]


def test_xml():
    body = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><loc>http://s.test/a?b&amp;c</loc><x y="http://s.test/d.js">see http://s.test/e</x></other>'
    assets, outlinks, error = xml_links.extract(body)
    assert assets == ["http://www.sitemaps.org/schemas/sitemap/0.9", "http://s.test/d.js"] and outlinks == ["http://s.test/a?b&c", "http://s.test/e"] and error is None
    assert xml_links.is_sitemap(body) and xml_links.is_sitemap("<!-- sitemaps.org/schemas/sitemap/ -->") and not xml_links.is_sitemap("<a/>")
    assert xml_links.extract("")[2] == "empty"
    assert xml_links.extract("<a>http://s.test/x</a> < b")[0:2] == ([], [])


def test_listings():
    s3 = "<ListBucketResult><IsTruncated>true</IsTruncated><NextContinuationToken>t/1</NextContinuationToken><Contents><Key>k</Key><Size>3</Size></Contents>{}</ListBucketResult>"
    url = "https://b.test/?list-type=2"
    assert xml_links.listing(url, "AmazonS3", s3.format(""))[0] == ["https://b.test/k", "https://b.test/?continuation-token=t%2F1&list-type=2"]
    assert xml_links.listing(url, "AmazonS3", s3.format("<CommonPrefixes><Prefix>p/</Prefix></CommonPrefixes>"))[0][0] == "https://b.test/?list-type=2&prefix=p%2F"
    assert xml_links.listing(url, "AmazonS3", "<html>")[1]
    azure = "<EnumerationResults><Blobs><Blob><Name>/x y</Name></Blob></Blobs><NextMarker>m</NextMarker></EnumerationResults>"
    assert xml_links.listing("https://a.test/c?comp=list", "Windows-Azure-Blob/1.0", azure)[0] == ["https://a.test/c?comp=list&marker=m", "https://a.test/c/x%20y"]


def test_pdf():
    body = b"%PDF /URI (http://s.test/a\\)b)\n1 0 obj\nstream\n" + zlib.compress(b"<</URI(http://s.test/c)>>") + b"\nendstream"
    assert pdf_links.extract(body) == ["http://s.test/a)b", "http://s.test/c"]


def test_script_and_charset():
    assert html_links.script_json('var x = {"a": "}"}; more') == '{"a": "}"}'
    assert html_links.script_json("nothing") is None
    d = html_links.detect_charset
    assert d(b"x", "text/html; charset=iso-8859-1") == "windows-1252"
    assert d(b'<meta charset="gb2312">', None) == "gbk" and d(b'<meta charset="gbk">', "text/html; charset=utf-8") == "utf-8"
    assert d("é".encode(), "text/html; charset=unknown-x") == "utf-8" and d(b"\xe9", None) == "windows-1252" and d(b"\xef\xbb\xbfx", None) == "utf-8"
