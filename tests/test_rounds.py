"""The queue and the seen-set of a crawl between its rounds, and what a round reads of the captured responses."""

import itertools

import pytest
from pyspark.sql import functions as F

from dredge.config import CrawlConfig
from dredge.job import _QUEUE, CrawlJob
from dredge.operators import rounds
from dredge.operators.fetch import ReplayFetcher

HTML = {"content-type": "text/html"}


@pytest.fixture
def keep(spark, tmp_path):
    def kept(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    return kept


def queued(raw, hops=0, parent=None, depth=0):
    return (raw, parent, "seed", hops, parent, 0, depth, None, None)


def test_queue_order(spark, keep):
    """Every take is the head of what waits, whatever came when; rows for one fetch count once."""
    waiting, model = rounds.Waiting(spark, keep, _QUEUE), []
    adds = [
        [queued(f"http://s.test/{i:02}") for i in range(0, 20, 2)] + [queued(None), queued("/é", parent="http://b.test/")],
        [queued(f"http://s.test/{i:02}", parent=p) for i in range(1, 12, 3) for p in ("http://b.test/", "http://a.test/")],
        [queued("/é", parent="http://a.test/"), queued("/é", parent="http://b.test/"), queued("http://s.test/10"), queued("http://s.test/00", hops=1, depth=2)],
    ]
    order = lambda r: (r[3], r[0] is not None, r[0] or "", r[1] or "")  # noqa: E731  (kinds and redirects are all the same)
    for rows in itertools.chain(adds, [[]] * 10):
        if rows:
            waiting.add(spark.createDataFrame(rows, _QUEUE), 4)
        best = {}
        for r in (*model, *rows):
            key = (r[0], r[3], r[1] if r[0] is None or r[0].startswith("/") else "")
            best[key] = min(best.get(key, r), r, key=order)
        model = sorted(best.values(), key=order)
        assert waiting.rows >= len(model) and sorted(map(tuple, waiting.table().collect()), key=order) == model
        if not model:
            break
        got = sorted((tuple(r) for r in waiting.take(4).collect()), key=order)
        assert got == model[:4]
        model = model[4:]
    assert not model and not waiting.rows and waiting.table().isEmpty()


def test_seen_log(spark, keep, monkeypatch):
    monkeypatch.setattr(rounds, "FAN", 2)
    log = rounds.Seen(spark, keep)
    assert log.within("a", "z").isEmpty() and log.table().isEmpty()
    for rows in ([("a", "asset"), ("c", "seed")], [("b", "seed"), ("a", "seed")], [], [("x", "asset")]):
        urls = [u for u, _ in rows]
        log.add(spark.createDataFrame(rows, "url string, kind string"), min(urls, default=None), max(urls, default=None))
    assert [len(level) for level in log.levels] == [1, 1]
    assert {tuple(r) for r in log.within("b", "w").collect()} == {("b", "seed"), ("c", "seed")}
    assert log.within("d", "w").isEmpty() and log.within(None, None).isEmpty()
    assert {tuple(r) for r in log.table().collect()} == {("a", "seed"), ("b", "seed"), ("c", "seed"), ("x", "asset")}


def crawl(spark, responses, seeds, **settings):
    return CrawlJob(spark, CrawlConfig(**settings), ReplayFetcher(responses)).run(spark.createDataFrame([(s,) for s in seeds], "value string"))


def test_link_of_all_pages(spark):
    """A link that every page carries is fetched once, and takes one place of a batch."""
    pages = [f"http://s.test/p{i}" for i in range(6)]
    rows = [(p, 200, HTML, bytearray(b'<a href="/hub">x</a>')) for p in pages]
    got = crawl(spark, spark.createDataFrame(rows, "url string, status int, headers map<string,string>, body binary"), pages, max_hops=1, batch=2)
    assert got.finished and got.rounds == 4
    assert sorted((r["url"], r["hops"], r["via"]) for r in got.captures.collect()) == sorted([(p, 0, None) for p in pages] + [("http://s.test/hub", 1, pages[0])])
    assert got.seen.count() == 7 and got.frontier.isEmpty()


def test_responses_once(spark):
    """What makes the captured responses runs as often for many rounds as for one."""

    def runs(batch):
        made = spark.sparkContext.accumulator(0)

        @F.udf("binary")
        def body(i):
            made.add(1)
            return b"text %d" % i

        responses = spark.range(6).select(F.concat(F.lit("http://s.test/p"), "id").alias("url"), F.lit(200).alias("status"), F.create_map(F.lit("content-type"), F.lit("text/plain")).alias("headers"), body.asNondeterministic()("id").alias("body"))
        got = crawl(spark, responses, [f"http://s.test/p{i}" for i in range(6)], batch=batch)
        assert got.captures.where("result = 'archived'").count() == 6
        return made.value, got.rounds

    (one, n), (many, m) = runs(6), runs(2)
    assert (n, m) == (1, 3) and many == one


def test_stopped_crawl(spark):
    """What is left when the rounds end is the frontier."""
    rows = [("http://s.test/a", 200, HTML, bytearray(b'<a href="/x">x</a><a href="/y">y</a>'))]
    got = crawl(spark, spark.createDataFrame(rows, "url string, status int, headers map<string,string>, body binary"), ["http://s.test/b", "http://s.test/a", "http://s.test/c"], max_hops=1, batch=1, max_rounds=1)
    assert not got.finished and got.captures.count() == 1
    assert sorted((r["raw"], r["hops"]) for r in got.frontier.collect()) == [("http://s.test/b", 0), ("http://s.test/c", 0), ("http://s.test/x", 1), ("http://s.test/y", 1)]
