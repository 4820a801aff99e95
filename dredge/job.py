"""The crawl as rounds over tables: a fixpoint that ends when the frontier is empty.

    pick -> normalise -> scope -> seen -> fetch -> outcome -> extract -> assets (same seed) and outlinks (new seeds)

Each round is a plan of its own that ends in tables in the shared folder, so lineage stays short and a
lost executor costs a task. Bodies are joined last and dropped first. A round costs its own rows: the queue
and the seen-set are tables by range, of which it reads what it meets (`rounds`), and so are captured responses.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.config import CrawlConfig
from dredge.functions import columns as C
from dredge.functions.html_links import decode_body
from dredge.functions.web_url import normalize_url
from dredge.operators import archive, domains, extract, fetch, ratelimit, rounds, scope, seen, store
from dredge.operators.fetch import Fetcher

#: What an item carries besides its link: redirects so far, depth below its seed without them, media class of
#: the item above it, and for what an embedded style sheet imports the number of imports so far.
_STATE = ("hops", "via", "redirects", "depth", "up", "jumps")
_QUEUE = "raw string, parent string, kind string, hops int, via string, redirects int, depth int, up string, jumps int"
_CAPTURE = "url string, kind string, hops int, via string, redirects int, depth int, status int, result string, discard_reason string, mime string, digest string, size int, state string"
_LINK = "page_url string, url string, kind string, tag string, pos int, hops int"


@dataclass
class CrawlResult:
    """captures (with revisit_of), links, what is left of the frontier, the seen-set, rounds, and if it came to an end."""

    captures: DataFrame
    links: DataFrame
    frontier: DataFrame
    seen: DataFrame
    rounds: int
    finished: bool


class CrawlJob:
    """Crawl from seeds (value) with a fetcher; assets are crawled in the round after their page's."""

    def __init__(self, spark: SparkSession, config: CrawlConfig, fetcher: Fetcher, folder: str | None = None, reload: Callable[[CrawlConfig], CrawlConfig] | None = None) -> None:
        """reload, if given, gives the settings of the next round, such as exclusions that have changed."""
        self.spark, self.config, self.fetcher, self.reload = spark, config, fetcher, reload
        self.folder = f"{(folder or store.folder(spark)).rstrip('/')}/crawl-{uuid.uuid4().hex}"

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def preprocess(self, rows: DataFrame, known: rounds.Seen, number: int) -> tuple[DataFrame, tuple[str | None, str | None]]:
        """url, parent, kind and state of what is to be fetched: normalised, in scope, unseen, once each; and the range of the URLs."""
        c = self.config
        done = rows.withColumn("n", normalize_url(F.col("raw"), F.col("parent"), c.max_url_length, c.max_segment_repetition, c.max_segment_threshold))
        done = self._keep(done.select(F.col("n.url").alias("url"), F.col("n.error").alias("error"), "parent", "kind", *_STATE), f"normal-{number}")
        span = tuple(done.agg(F.min("url"), F.max("url")).first())
        good = done.where("url is not null").where(scope.in_scope(F.col("url"), c))
        good = good.where((F.col("kind") == "seed") | (F.col("redirects") > 0) | ~C.path(F.col("url")).isin("", "/"))
        order = F.struct("hops", F.when(F.col("kind") == "seed", 0).otherwise(1), "redirects", "parent")
        first = good.groupBy("url").agg(F.min_by(F.struct("parent", "kind", *_STATE), order).alias("r")).select("url", "r.*")
        if c.disable_seencheck:
            return first, span
        # Where a redirect leads is fetched though it was seen: it is the same item.
        checked = seen.check(first, known.within(*span), ["hops", "kind"])
        return checked.where("verdict <> 'seen' OR redirects > 0").drop("verdict"), span

    def fetched(self, todo: DataFrame) -> DataFrame:
        """todo joined with the attempts that end their retries; what a browser has captured needs no status."""
        c = self.config
        answers = self.fetcher.fetch(todo)
        ended = fetch.outcome(answers.where("attempt is not null").select("url", "attempt", "status", "headers"), c)
        full = answers.join(ended.select("url", F.col("attempt").alias("end"), "discard_reason", "result"), "url", "left")
        full = full.where(F.col("attempt").isNull() | (F.col("attempt") == F.col("end")))
        rendered = F.lit(c.headless) & F.col("status").isNull() & F.col("body").isNotNull()
        result = F.when(rendered, "archived").otherwise(F.coalesce("result", F.lit("failed")))
        return full.withColumn("result", result).withColumn("mime", F.when(rendered, "text/html").otherwise(fetch.mime(F.col("headers"), F.col("body"))))

    def settled(self, got: DataFrame) -> DataFrame:
        """got plus what becomes of each item (`next`, `state`), its media class, and its place in a chain of style sheets."""
        class_ = C.mime_class(F.col("mime"))
        embedded = (class_ == "css") & ((F.col("up") == "html") | ((F.col("up") == "css") & F.col("jumps").isNotNull()))
        rows = got.withColumn("class", class_).withColumn("embedded_css", F.coalesce(embedded, F.lit(False)))
        rows = rows.withColumn("chain", F.when(F.col("embedded_css"), F.when(F.col("up") == "html", 0).otherwise(F.col("jumps") + 1)))
        items = rows.withColumn("code", F.col("status")).withColumn("location", F.element_at("headers", "location")).withColumn("plain_depth", F.col("depth"))
        items = items.withColumn("mime", F.coalesce("mime", F.lit("")))
        return fetch.after_response(items, self.config).withColumn("next", F.when((F.col("next") == "extract") & ((F.col("result") != "archived") | F.col("body").isNull()), "none").otherwise(F.col("next")))

    def extracted(self, got: DataFrame, number: int) -> DataFrame:
        """Links of the pages of a round, with the media class, chain and depth of their page."""
        pages = got.where("next = 'extract'")
        text = pages.withColumn("d", decode_body(fetch.retain(F.col("body"), F.col("mime")), F.element_at("headers", "content-type")))
        context = F.struct("class", "chain", "depth")
        rows = text.select("url", "mime", "headers", F.coalesce("d.text", F.lit("")).alias("text"), "hops", F.col("d.charset").alias("charset"), "embedded_css", context.alias("context"))
        return self._keep(extract.links(rows, self.config), f"links/round={number}")

    def children(self, found: DataFrame, patterns: domains.DomainPatterns) -> DataFrame:
        """Queue rows of a round's links: assets below their page, imports up to the limit, outlinks as seeds."""
        c = self.config
        take_assets = not c.disable_assets and not c.headless
        own = found.where("kind <> 'outlink'").where(F.lit(take_assets)).where((F.col("kind") != "import") | (F.coalesce("context.chain", F.lit(0)) < c.max_css_jump))
        raw = (F.col("url").alias("raw"), F.col("page_url").alias("parent"))
        below = (F.col("page_url").alias("via"), F.lit(0).alias("redirects"))
        assets = own.select(*raw, F.lit("asset").alias("kind"), "hops", *below, (F.col("context.depth") + 1).alias("depth"), F.col("context.class").alias("up"), F.col("context.chain").alias("jumps"))
        out = domains.rewrite_hops(found.where("kind = 'outlink'").select("url", "page_url", "hops"), patterns, c.max_hops)
        none = F.lit(None)
        return assets.unionByName(out.select(*raw, F.lit("seed").alias("kind"), "hops", *below, F.lit(0).alias("depth"), none.cast("string").alias("up"), none.cast("int").alias("jumps")))

    def schedule(self, captures: DataFrame) -> DataFrame:
        """url, round and the second of its round at which each fetch may start by its host's bucket."""
        c = self.config
        host = F.concat_ws(" ", F.col("round").cast("string"), C.hostname(F.col("url")))
        keyed = captures.select(host.alias("host"), F.lit(0.0).alias("ts"), F.coalesce("status", F.lit(0)).alias("code"), F.xxhash64("url").alias("seq"), "url", "round")
        starts = ratelimit.replay(keyed, c.rate_capacity, c.rate_refill).select("host", "seq", "start")
        return keyed.select("host", "seq", "url", "round").join(starts, ["host", "seq"]).select("url", "round", "start")

    def run(self, seeds: DataFrame) -> CrawlResult:
        c, spark = self.config, self.spark
        patterns = domains.classify(list(c.domains_crawl))
        none = F.lit(None).cast("string")
        queue = seeds.select(F.col("value").alias("raw"), none.alias("parent"), F.lit("seed").alias("kind"), F.lit(0).alias("hops"), none.alias("via"), F.lit(0).alias("redirects"), F.lit(0).alias("depth"), none.alias("up"), F.lit(None).cast("int").alias("jumps"))
        waiting, known = rounds.Waiting(spark, self._keep, _QUEUE), rounds.Seen(spark, self._keep)
        waiting.add(queue, c.batch)
        number, linked = 0, False
        while number < c.max_rounds and waiting.rows:
            if self.reload is not None:
                c = self.config = self.reload(c)
            todo, span = self.preprocess(waiting.take(c.batch), known, number)
            todo = self._keep(todo, f"todo-{number}")
            got = self._keep(self.settled(self.fetched(todo)), f"got-{number}")
            known.add(todo.select("url", "kind"), *span)
            self._keep(got.select("url", "kind", "hops", "via", "redirects", "depth", "status", "result", "discard_reason", "mime", F.sha2("body", 256).alias("digest"), F.octet_length("body").alias("size"), "state"), f"captures/round={number}")
            new = got.where("next = 'redirect'").select(F.col("location").alias("raw"), F.col("url").alias("parent"), "kind", "hops", F.col("url").alias("via"), (F.col("redirects") + 1).alias("redirects"), "depth", "up", "jumps")
            if not got.where("next = 'extract'").isEmpty():
                new, linked = new.unionByName(self.children(self.extracted(got, number), patterns)), True
            number += 1
            waiting.add(new, c.batch)
        empty = lambda kind: spark.createDataFrame([], kind + ", round int")
        if not number:
            return CrawlResult(empty(_CAPTURE).withColumn("revisit_of", none), empty(_LINK), waiting.table(), known.table(), 0, True)
        captures = spark.read.schema(_CAPTURE + ", round int").parquet(f"{self.folder}/captures")
        captures = archive.revisits(captures, ["round"], c.dedupe_min_size)
        links = spark.read.schema(_LINK + ", round int").parquet(f"{self.folder}/links") if linked else empty(_LINK)
        return CrawlResult(captures, links, waiting.table(), known.table(), number, not waiting.rows)
