"""A replayed crawl of a small site, and the streams."""

import pytest

from dredge import sql
from dredge.config import CrawlConfig
from dredge.job import CrawlJob
from dredge.operators.fetch import ReplayFetcher
from dredge.streaming import streams

SITE = {
    "/": '<a href="/one">1</a><a href="http://other.test/">x</a><img src="/pic.png">',
    "/one": '<a href="/two">2</a><a href="/three">3</a>',
    "/two": "two",
    "/three": '<a href="/four">4</a>',
    "/four": "four",
}


@pytest.fixture(scope="module")
def responses(spark):
    html = {"content-type": "text/html"}
    rows = [(f"http://site.test{p}", 200, html, bytearray(b.encode())) for p, b in SITE.items()]
    rows += [("http://other.test/", 200, html, bytearray(b"other")), ("http://site.test/pic.png", 200, {"content-type": "image/png"}, bytearray(b"\x89PNG"))]
    rows += [("http://site.test/moved", 302, {"location": "/two"}, None)]
    return spark.createDataFrame(rows, "url string, status int, headers map<string,string>, body binary")


def crawl(spark, responses, seeds, **settings):
    job = CrawlJob(spark, CrawlConfig(**settings), ReplayFetcher(responses))
    result = job.run(spark.createDataFrame([(s,) for s in seeds], "value string"))
    return {r["url"].removeprefix("http://"): r["hops"] for r in result.captures.where("result = 'archived'").collect()}


def test_one_hop(spark, responses):
    assert crawl(spark, responses, ["http://site.test/"], max_hops=1) == {"site.test/": 0, "site.test/one": 1, "other.test/": 1, "site.test/pic.png": 0}


def test_domain_crawl(spark, responses):
    got = crawl(spark, responses, ["http://site.test/"], max_hops=1, domains_crawl=("site.test",))
    assert got == {"site.test/": 0, "site.test/one": 0, "site.test/two": 0, "site.test/three": 0, "site.test/four": 0, "other.test/": 1, "site.test/pic.png": 0}


def test_redirect_and_exclusion(spark, responses):
    assert crawl(spark, responses, ["http://site.test/moved"]) == {"site.test/moved": 0, "site.test/two": 0}
    assert crawl(spark, responses, ["http://site.test/one"], max_hops=1, exclusions=("/two$",)) == {"site.test/one": 0, "site.test/three": 1}
    assert crawl(spark, responses, ["localhost", "ftp://x.test/"]) == {}


def replay(spark, rows, seeds, **settings):
    """Captures of a crawl over (path, status, headers, body) of one host, by path."""
    answers = [(f"http://site.test{p}", status, headers, None if body is None else bytearray(body.encode())) for p, status, headers, body in rows]
    job = CrawlJob(spark, CrawlConfig(**settings), ReplayFetcher(spark.createDataFrame(answers, "url string, status int, headers map<string,string>, body binary")))
    result = job.run(spark.createDataFrame([(f"http://site.test{s}",) for s in seeds], "value string"))
    assert result.finished
    return job, result, {r["url"].removeprefix("http://site.test"): r for r in result.captures.collect()}


def test_redirect_limit(spark):
    rows = [(f"/r{i}", 302, {"location": f"/r{i + 1}"}, None) for i in range(8)]
    _, _, got = replay(spark, rows, ["/r0"], max_redirect=3)
    assert {p: (r["redirects"], r["state"]) for p, r in got.items()} == {"/r0": (0, "GotRedirected"), "/r1": (1, "GotRedirected"), "/r2": (2, "GotRedirected"), "/r3": (3, "Completed")}
    assert CrawlConfig().max_redirect == 20 and CrawlConfig().max_css_jump == 10


def test_style_sheet_chain(spark):
    css = {"content-type": "text/css"}
    rows = [("/", 200, {"content-type": "text/html"}, '<link rel=stylesheet href="/c0.css">')]
    rows += [(f"/c{i}.css", 200, css, f'@import "/c{i + 1}.css"; a{{background:url(/i{i}.png)}}') for i in range(6)]
    rows += [("/alone.css", 200, css, '@import "/never.css"; a{background:url(/never.png)}')]
    _, _, got = replay(spark, rows, ["/", "/alone.css"], max_css_jump=2)
    assert set(got) == {"/", "/alone.css", "/c0.css", "/c1.css", "/c2.css", "/i0.png", "/i1.png", "/i2.png"}


def test_depth_and_asset_gates(spark):
    html = {"content-type": "text/html"}
    rows = [("/", 200, html, '<img src="/frame.html"><a href="/out">x</a>'), ("/frame.html", 200, html, '<img src="/deep.png">'), ("/out", 200, html, "out")]
    _, _, got = replay(spark, rows, ["/"], max_hops=1)
    assert set(got) == {"/", "/frame.html", "/out"}
    _, _, got = replay(spark, rows, ["/"], max_hops=1, disable_assets=True)
    assert set(got) == {"/"}


def test_rendered_pages(spark):
    rows = [("/", None, None, '<img src="/a.png"><a href="/out">x</a>'), ("/out", None, None, "rendered")]
    _, _, got = replay(spark, rows, ["/"], max_hops=1, headless=True)
    assert {p: r["result"] for p, r in got.items()} == {"/": "archived", "/out": "archived"}


def test_revisits_and_schedule(spark):
    rows = [(p, 200, {"content-type": "text/plain"}, "same body" * 200) for p in ("/a", "/b", "/c")]
    job, result, got = replay(spark, rows, ["/a", "/b", "/c"], rate_capacity=2.0, rate_refill=1.0)
    assert sorted(r["revisit_of"] or "" for r in got.values()) == ["", "http://site.test/a", "http://site.test/a"]
    assert sorted(r["start"] for r in job.schedule(result.captures).collect()) == [0.0, 0.0, 1.0]


def test_reload(spark, responses):
    """Exclusions that change between rounds hold from the next round on."""
    import dataclasses

    rounds = []
    job = CrawlJob(spark, CrawlConfig(max_hops=2), ReplayFetcher(responses), reload=lambda c: (rounds.append(1), dataclasses.replace(c, exclusions=("/two$",) if len(rounds) > 1 else ()))[1])
    got = {r["url"] for r in job.run(spark.createDataFrame([("http://site.test/",)], "value string")).captures.where("result = 'archived'").collect()}
    assert "http://site.test/three" in got and "http://site.test/two" not in got


def test_url_stream(spark, tmp_path):
    """Lists that appear in a folder, handed to a producer; paused and resumed from its checkpoint."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("# note\nhttp://a.test/\n")
    found: list[str] = []
    start = lambda: streams.producer(streams.url_stream(spark, str(tmp_path / "in"), 1), lambda df, _: found.extend(r["value"] for r in df.collect()), "0 seconds", str(tmp_path / "c"))
    running = streams.Pausable(start)
    running.query.processAllAvailable()
    running.pause()
    assert running.paused and found == ["http://a.test/"]
    (tmp_path / "in" / "b.txt").write_text("http://b.test/\n")
    running.resume()
    running.query.processAllAvailable()
    running.pause()
    assert found == ["http://a.test/", "http://b.test/"]
    events = spark.createDataFrame([("h", "2024-01-01 00:00:00"), ("h", "2024-01-01 00:00:03"), ("h", "2024-01-01 00:01:00")], "host string, t string").selectExpr("host", "cast(t as timestamp) ts")
    assert sorted(r["n"] for r in streams.session_stream(events, "ts", "10 seconds", "host").collect()) == [1, 2]


def test_batches(spark, responses):
    assert crawl(spark, responses, ["http://site.test/"], max_hops=1, batch=1) == {"site.test/": 0, "site.test/one": 1, "other.test/": 1, "site.test/pic.png": 0}


def test_sql_functions(spark):
    names = sql.register(spark)
    assert "normalize_url" in names
    row = spark.sql("SELECT normalize_url('/x', 'http://s.test/a') AS n, reverse_host('a.b.c:80') AS r, decode_hops('LL') AS h, html_outlinks('<a href=\"/y\">', 'http://s.test/') AS o").collect()[0]
    more = spark.sql("SELECT link_header('<http://a.test>; rel=x, <http://b.test>') AS l, text_links('a http://s.test/x, (https://t.test/)') AS t, has_path_loop('/a/a/a/a', '') AS p, has_path_loop('/a/b/a/b/a/b/c/d/e/f', '') AS q, has_path_loop('/a/a/a', 'x=1&x=1') AS r").collect()[0]
    assert more["l"] == ["http://a.test", "http://b.test"] and more["t"] == ["http://s.test/x", "https://t.test/)"] and (more["p"], more["q"], more["r"]) == (True, True, False)
    assert row["n"]["url"] == "http://s.test/x" and row["r"] == "c.b.a:80" and row["h"] == 2 and row["o"][0]["url"] == "http://s.test/y"


def test_streams(spark, tmp_path):
    spark.createDataFrame([("u1", "asset"), ("u1", "seed"), ("u2", "seed"), ("u2", "seed")], "url string, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, kind string").parquet(str(tmp_path / "in"))
    q = streams.seen_stream(stream).writeStream.format("memory").queryName("seen_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM seen_out").collect())
    assert got == [("u1", "asset", "keep"), ("u1", "seed", "promote"), ("u2", "seed", "keep"), ("u2", "seed", "seen")]
    spark.createDataFrame([("h", 0.0, 200, 1), ("h", 0.0, 429, 2), ("h", 0.0, 200, 3)], "host string, ts double, code int, seq long").coalesce(1).write.parquet(str(tmp_path / "b"))
    # A state timeout would keep an available-now query in batches without data.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema("host string, ts double, code int, seq long").parquet(str(tmp_path / "b"))
    q = streams.bucket_stream(stream, 10, 1).writeStream.format("memory").queryName("bucket_out").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["seq"]: (r["start"], r["failures"]) for r in spark.sql("SELECT * FROM bucket_out").collect()}
    assert got == {1: (0.0, 0), 2: (0.0, 1), 3: (6.0, 0)}
