"""Crawl operators on small tables."""

import pytest
from pyspark.sql import functions as F

from dredge.config import CrawlConfig
from dredge.operators import domains, extract, fetch, frontier, metrics, ratelimit, scope, seen, tree
from dredge.plans import linking
from dredge.schemas import FRONTIER
from dredge.sources import lists
from dredge.sources.archive_sink import CrawlArchive


def test_domains(spark):
    patterns = domains.classify(["Site.test.", "https://full.test/x", "http://host.test", r"^https?://re[0-9]/"])
    assert patterns.domains == ["site.test"] and len(patterns.urls) == 2 and len(patterns.regexes) == 1
    urls = {"http://site.test/": True, "http://a.SITE.test:8080/": True, "http://notsite.test/": False, "https://full.test/x": True, "https://full.test/y": False, "http://sub.host.test/": True, "https://re5/": True, "nothing": False}
    got = domains.matched(spark.createDataFrame([(u,) for u in urls], "url string"), patterns).collect()
    assert {r["url"]: r["matched"] for r in got} == urls
    with pytest.raises(Exception):
        domains.classify(["("])


def test_scope(spark):
    items = spark.createDataFrame([("http://a.test/x", None, 0), ("http://b.test/", "p", 0), ("http://archive.org/x", None, 0), ("http://a.test/", "p", 0), ("http://a.test/", "p", 1)], "url string, parent_id string, redirects int")
    got = [r["outcome"] for r in scope.apply_scope(items, CrawlConfig(exclude_strings=("zzz",))).collect()]
    assert got == ["go", "removed", "completed", "removed", "go"]


def test_frontier(spark):
    rows = [("a", "u1", None, 1, "FRESH", 5), ("b", "u2", None, 0, "FRESH", 9), ("c", "u3", None, 0, "CLAIMED", 1), ("d", "u4", None, 0, "FRESH", 2)]
    f = spark.createDataFrame(rows, FRONTIER)
    picked = frontier.pick(f, 2)
    assert [r["id"] for r in picked.collect()] == ["d", "b"]
    claimed = frontier.claim(f, picked, 100)
    assert {(r["id"], r["status"], r["timestamp"]) for r in claimed.collect()} == {("a", "FRESH", 5), ("b", "CLAIMED", 100), ("c", "CLAIMED", 1), ("d", "CLAIMED", 100)}
    assert frontier.already_in_flight(picked, claimed).count() == 2 and frontier.already_in_flight(picked, f).count() == 0
    new = spark.createDataFrame([("x", "u1", None, 0, "FRESH", 1), ("y", "u9", None, 2, "FRESH", 1), ("z", "u9", None, 1, "FRESH", 1)], FRONTIER)
    assert [r["id"] for r in frontier.add(f, new).collect()] == ["z"]
    assert frontier.delete(f, picked).count() == 2
    back = frontier.from_remote(frontier.to_remote(f))
    assert sorted(r["hops"] for r in back.collect()) == [0, 0, 0, 1]


def test_seen(spark):
    known = spark.createDataFrame([("u1", "asset"), ("u2", "seed")], "url string, kind string")
    new = spark.createDataFrame([("u1", "seed", 1), ("u1", "asset", 2), ("u2", "seed", 3), ("u3", "asset", 4), ("u3", "asset", 5), ("u3", "seed", 6)], "url string, kind string, n int")
    got = seen.check(new, known, ["n"])
    assert {r["n"]: r["verdict"] for r in got.collect()} == {1: "promote", 2: "seen", 3: "seen", 4: "keep", 5: "seen", 6: "promote"}
    merged = seen.merge(known, seen.updates(got))
    assert {tuple(r) for r in merged.collect()} == {("u1", "seed"), ("u2", "seed"), ("u3", "seed")}


def test_tree(spark):
    rows = [("s", "s", None, "u0", "", "GotChildren", "Queue"), ("a", "s", "s", "u1", "", "GotRedirected", "Queue"), ("b", "s", "a", "u2", "", "Completed", "Queue"), ("c", "s", "s", "u2", "", "Seen", "Queue")]
    items = spark.createDataFrame(rows, "item_id string, seed_id string, parent_id string, url string, seed_via string, status string, source string")
    deep = tree.with_depth(items)
    assert {(r["item_id"], r["depth"], r["plain_depth"]) for r in deep.collect()} == {("s", 0, 0), ("a", 1, 0), ("b", 2, 1), ("c", 1, 1)}
    assert {r["item_id"] for r in tree.dedupe(deep).collect()} == {"s", "a", "b"}
    assert {r["status"] for r in tree.complete(items).collect()} == {"Completed", "Seen"}
    assert tree.violations(items).count() == 0
    bad = items.withColumn("status", F.when(F.col("item_id") == "s", "Fresh").otherwise(F.col("status")))
    assert {r["rule"] for r in tree.violations(bad).collect()} >= {"fresh with children"}
    grown = tree.add_children(items, spark.createDataFrame([("k", "s", "c", "u9", "", "Fresh", "Queue")], items.schema), "GotChildren")
    assert {(r["item_id"], r["status"]) for r in grown.collect()} >= {("k", "Fresh"), ("c", "GotChildren")}
    assert tree.draw([("s", None, "seed"), ("a", "s", "one"), ("b", "a", "two"), ("c", "s", "three")]) == "seed\n├── one\n│   └── two\n└── three"


def test_css_jumps(spark):
    rows = [("h", None, "html", "GotChildren"), ("c1", "h", "css", "GotChildren"), ("c2", "c1", "css", "GotRedirected"), ("c3", "c2", "css", "Archived"), ("x", "h", "other", "GotChildren"), ("c4", "x", "css", "Archived")]
    items = spark.createDataFrame(rows, "item_id string, parent_id string, mime string, status string")
    assert {tuple(r) for r in tree.css_jumps(items).collect()} == {("c1", 0), ("c2", 1), ("c3", 1)}


def test_bucket():
    b = ratelimit.fresh(2, 1, 0.0)
    assert [b.start(0.0), b.start(0.0), b.start(0.0)] == [0.0, 0.0, 1.0]
    b.answer(429, 1.0)
    assert b.penalty_until == 6.0 and b.tokens == 0
    b.answer(429, 2.0)
    assert b.penalty_until == 12.0
    b.answer(200, 3.0)
    assert b.failures == 2
    b.answer(200, 13.0)
    assert b.failures == 1
    b.answer(503, 14.0)
    assert b.failures == 2 and b.rate == 0.5
    for t in range(20, 120):
        b.answer(200, float(t))
    assert 0.99 < b.rate <= 1 and b.failures == 0


def test_outcomes(spark):
    rows = [("a", 0, 503, {}), ("a", 1, 200, {}), ("b", 0, 403, {"cf-mitigated": "challenge"}), ("b", 1, 403, {"cf-mitigated": "challenge"}), ("c", 0, 403, {"server": "AkamaiGHost"}), ("d", 0, None, {}), ("e", 0, 429, {})]
    got = fetch.outcome(spark.createDataFrame(rows, "url string, attempt int, status int, headers map<string,string>"))
    assert {r["url"]: (r["attempt"], r["result"], r["discard_reason"]) for r in got.collect()} == {"a": (1, "archived", None), "b": (1, "failed", "cloudflare"), "c": (0, "discarded", "akamai"), "d": (0, "failed", None), "e": (0, "failed", "status")}


def test_disk():
    gib = 1 << 30
    assert fetch.disk_low(512 * gib, 49 * gib) and not fetch.disk_low(512 * gib, 51 * gib)
    assert not fetch.disk_low(128 * gib, 26 * gib) and fetch.disk_low(128 * gib, 24 * gib) and fetch.disk_low(512 * gib, 99 * gib, 100)


def test_lists_and_logs(spark, tmp_path):
    p = tmp_path / "l.txt"
    p.write_text("# note\n\n http://a.test/ \nhttp://b.test/\n")
    assert [r[0] for r in lists.read_list(spark, [str(p)]).collect()] == ["http://a.test/", "http://b.test/"]
    with pytest.raises(ValueError):
        lists.read_list(spark, [])
    with pytest.raises(ValueError):
        lists.from_urls(spark, ["no url"])
    bad = tmp_path / "x.txt"
    bad.write_text("(\n")
    with pytest.raises(Exception):
        lists.read_exclusions(spark, [str(bad)])
    assert lists.read_exclusions(spark, [str(bad)], skip_broken=True) == ()
    rows = lists.logfmt(spark.createDataFrame([('time=1 level=x msg="a b" k=',), ("level=x",), ("time=1 level=x k=1 k=2",)], "value string")).collect()
    assert [(r["record"], r["duplicate"]) for r in rows] == [({"time": "1", "level": "x", "msg": "a b", "k": ""}, False), ({"time": "1", "level": "x", "k": "1"}, True)]
    assert lists.to_frontier(spark.createDataFrame([("u",), ("u",)], "value string")).count() == 1


def test_archive_round_trip(spark, tmp_path):
    spark.dataSource.register(CrawlArchive)
    rows = [("http://a.test/", bytearray(b"body\r\n\r\nmore"), "d1", None, 5), ("http://b.test/", bytearray(b"x"), "d1", "http://a.test/", 6), ("http://c.test/", None, None, None, 7)]
    df = spark.createDataFrame(rows, "url string, body binary, digest string, revisit_of string, captured_at long").repartition(2)
    df.write.format("crawl_archive").mode("append").option("path", str(tmp_path / "w")).save()
    got = {r["url"]: r for r in spark.read.format("crawl_archive").option("path", str(tmp_path / "w")).load().collect()}
    assert bytes(got["http://a.test/"]["body"]) == b"body\r\n\r\nmore" and got["http://b.test/"]["revisit_of"] == "http://a.test/" and got["http://b.test/"]["body"] is None
    assert bytes(got["http://c.test/"]["body"]) == b"" and got["http://c.test/"]["captured_at"] == 7


def test_archive_options(spark, tmp_path):
    import gzip
    import hashlib

    rows = [("http://a.test/", bytearray(b"body"), None, None, 5, None), ("http://b.test/", bytearray(b"gone"), None, None, 6, "status")]
    df = spark.createDataFrame(rows, "url string, body binary, digest string, revisit_of string, captured_at long, discard_reason string").coalesce(1)
    spark.dataSource.register(CrawlArchive)
    df.write.format("crawl_archive").mode("append").option("path", f"file://{tmp_path}/w").option("prefix", "P-").option("operator", "me").option("digest", "sha1").save()
    [file] = (tmp_path / "w").iterdir()
    assert file.name.startswith("P-") and b"operator: me" in gzip.open(file).read()
    [row] = spark.read.format("crawl_archive").option("path", f"file://{tmp_path}/w").load().collect()
    assert row["url"] == "http://a.test/" and row["digest"] == "sha1:" + hashlib.sha1(b"body").hexdigest()


def test_remote_lists(spark, tmp_path):
    import functools
    import http.server
    import threading

    (tmp_path / "l.txt").write_text("# note\nhttp://a.test/\n\nhttp://b.test/\n")
    quiet = type("Quiet", (http.server.SimpleHTTPRequestHandler,), {"log_message": lambda *a: None})
    server = http.server.HTTPServer(("127.0.0.1", 0), functools.partial(quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/l.txt"
    assert [r[0] for r in lists.read_list(spark, [url, str(tmp_path / "l.txt")]).collect()] == ["http://a.test/", "http://b.test/"] * 2
    assert lists.read_exclusions(spark, [url]) == ("http://a.test/", "http://b.test/")
    assert lists.read_patterns(spark, [str(tmp_path / "l.txt")])[1] == "http://a.test/"
    server.shutdown()


def test_frontier_source(spark):
    from dredge.sources.frontier_source import TableFrontier

    rows = spark.createDataFrame([(str(i), f"u{i}", None, i % 2, "FRESH", i) for i in range(5)], FRONTIER)
    queue = TableFrontier(spark, rows)
    queue.start()
    first = queue.pull(2, 50)
    assert [r["id"] for r in first.collect()] == ["0", "2"] and queue.rows.where("status = 'CLAIMED'").count() == 2
    queue.push(spark.createDataFrame([("9", "u1", None, 0, "FRESH", 1), ("8", "u8", None, 0, "FRESH", 1)], FRONTIER))
    queue.finish(first.limit(1))
    with pytest.raises(KeyError):
        queue.finish(spark.createDataFrame([("none",)], "id string"))
    queue.stop(60)
    assert {(r["id"], r["status"]) for r in queue.rows.collect()} == {("1", "FRESH"), ("2", "FRESH"), ("3", "FRESH"), ("4", "FRESH"), ("8", "FRESH")}


def test_exposition():
    assert metrics.exposition({"n": 3}, "crawl_", {"job": "j"}) == '# TYPE crawl_n gauge\ncrawl_n{job="j"} 3\n'
    text = metrics.exposition({"n": 3}, "c_", {"job": "j"}, ("n",), {"ms": [(20.0, 1), (float("inf"), 2)]})
    assert text.splitlines() == ["# TYPE c_n counter", 'c_n{job="j"} 3', "# TYPE c_ms histogram", 'c_ms_bucket{job="j",le="20.0"} 1', 'c_ms_bucket{job="j",le="+Inf"} 2', 'c_ms_count{job="j"} 2']


def test_empty_tables(spark):
    f = spark.createDataFrame([], FRONTIER)
    assert frontier.pick(f, 3).count() == 0 and frontier.add(f, f).count() == 0
    events = spark.createDataFrame([], "code int, ms long, bytes long, seed_done boolean, challenge string")
    assert metrics.snapshot(events).collect()[0]["mean_response_ms"] == 0


def test_capped_outlinks(spark, tmp_path):
    """Pages with one address are capped each by itself, in the query and among the links of responses."""
    page = "".join(f'<a href="/{{}}{i}">x</a>' for i in range(5))
    rows = [(1, "http://s.test/p", page.replace("{}", "a")), (2, "http://s.test/p", page.replace("{}", "b")), (3, "http://s.test/q", '<a href="/c0">x</a>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = linking.capped_outlinks(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["pos"]) for r in got) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0)]
    answers = pages.selectExpr("url", "'text/html' AS mime", "map('content-type', 'text/html') AS headers", "html AS text", "0 AS hops")
    found = extract.links(answers, CrawlConfig(max_outlinks=2))
    assert sorted(r["url"] for r in found.collect()) == [f"http://s.test/{x}" for x in ("a0", "a1", "b0", "b1", "c0")]
    assert found.columns == ["page_url", "url", "kind", "tag", "pos", "hops"]
