"""Command line: crawl URLs or lists against a table of captured responses.

    python -m dredge.cli url  --responses DIR --out DIR URL...
    python -m dredge.cli list --responses DIR --out DIR FILE...
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from dredge.config import CrawlConfig
from dredge.job import CrawlJob
from dredge.operators.fetch import ReplayFetcher
from dredge.sources import lists


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("kind", choices=("url", "list"))
    p.add_argument("what", nargs="+")
    p.add_argument("--responses", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--max-hops", type=int, default=0)
    p.add_argument("--max-outlinks", type=int, default=0)
    p.add_argument("--domains-crawl", action="append", default=[])
    p.add_argument("--exclude-host", action="append", default=[])
    p.add_argument("--include-host", action="append", default=[])
    p.add_argument("--exclusion-file", action="append", default=[])
    p.add_argument("--disable-assets-capture", action="store_true")
    p.add_argument("--strict-regex", action="store_true")
    p.add_argument("--max-redirect", type=int, default=20)
    p.add_argument("--max-css-jump", type=int, default=10)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("crawl").getOrCreate()
    seeds = lists.from_urls(spark, a.what) if a.kind == "url" else lists.read_list(spark, a.what)
    config = CrawlConfig(
        max_hops=a.max_hops, max_outlinks=a.max_outlinks, domains_crawl=tuple(a.domains_crawl), exclude_hosts=tuple(a.exclude_host), include_hosts=tuple(a.include_host),
        exclusions=lists.read_exclusions(spark, a.exclusion_file), disable_assets=a.disable_assets_capture,
        strict_regex=a.strict_regex, max_redirect=a.max_redirect, max_css_jump=a.max_css_jump,
    )
    result = CrawlJob(spark, config, ReplayFetcher(spark.read.parquet(a.responses)), a.out).run(seeds)
    result.captures.write.mode("overwrite").parquet(f"{a.out}/captures")
    result.links.write.mode("overwrite").parquet(f"{a.out}/links")
    if not result.finished:
        result.frontier.write.mode("overwrite").parquet(f"{a.out}/frontier")
        print(f"stopped after {result.rounds} rounds; what is left of the frontier is in {a.out}/frontier")
    return 0 if result.finished else 2


if __name__ == "__main__":
    raise SystemExit(main())
