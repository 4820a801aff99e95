"""Scope: which URLs of a round go on, and what becomes of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dredge.config import CrawlConfig
from dredge.functions import columns as C


def included(url: Column, config: CrawlConfig) -> Column:
    """True without include lists; else the host contains an include host or the URL an include string."""
    if not config.include_hosts and not config.include_strings:
        return F.lit(True)
    return C.contains_any(C.hostname(url), config.include_hosts) | C.contains_any(url, config.include_strings)


def excluded(url: Column, config: CrawlConfig) -> Column:
    """The host contains an excluded host, the URL an excluded string, or a pattern matches.

    Patterns are one alternation, so a row is matched once however many there are.
    """
    found = C.contains_any(C.hostname(url), config.all_excluded_hosts) | C.contains_any(url, config.exclude_strings)
    if config.exclusions:
        found = found | url.rlike("|".join(f"(?:{p})" for p in config.exclusions))
    return found


def in_scope(url: Column, config: CrawlConfig) -> Column:
    return included(url, config) & ~excluded(url, config)


def apply_scope(items: DataFrame, config: CrawlConfig) -> DataFrame:
    """Adds outcome: `go`, `completed` (seeds out of scope), `removed` (children out of scope or with an empty path)."""
    seed = F.col("parent_id").isNull()
    bare = ~seed & C.path(F.col("url")).isin("", "/") & ~F.coalesce(F.col("redirects"), F.lit(0)).cast("boolean")
    scoped = in_scope(F.col("url"), config)
    return items.withColumn("outcome", F.when(~scoped & seed, "completed").when(~scoped | bare, "removed").otherwise("go"))
