"""Domain patterns: naive domains with their subdomains, full URLs, and regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.functions import columns as C
from dredge.operators.store import written

#: Patterns up to this number are broadcast for certain; more are left to the optimiser.
BROADCAST_PATTERNS = 100_000


@dataclass
class DomainPatterns:
    domains: list[str] = field(default_factory=list)
    urls: list[str] = field(default_factory=list)
    regexes: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.domains or self.urls or self.regexes)


def classify(patterns: list[str]) -> DomainPatterns:
    """Scheme and host: a URL. A dot and none of / ? # or space: a domain. Else a regular expression, which must compile."""
    out = DomainPatterns()
    for p in patterns:
        if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+", p):
            out.urls.append(p)
        elif "." in p and not re.search(r"[/?# ]|://", p):
            out.domains.append(re.sub(r"\.$", "", p.lower()))
        else:
            re.compile(p)
            out.regexes.append(p)
    return out


def _domain_table(spark: SparkSession, patterns: DomainPatterns) -> DataFrame:
    # A URL pattern that names a host alone takes the host's subdomains too.
    hosts = [m[1].lower() for u in patterns.urls if (m := re.fullmatch(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)(?::[0-9]+)?/?", u))]
    names = sorted({*patterns.domains, *hosts})
    return spark.createDataFrame([(n,) for n in names], "domain string")


def matched(urls: DataFrame, patterns: DomainPatterns, column: str = "url") -> DataFrame:
    """urls with a boolean `matched`.

    The host suffixes of each distinct host are looked up in the pattern table by an equi-join, and so are
    URLs in that of full URLs, so the cost does not grow with the number of patterns. Hosts that match are
    written before they are joined with the URLs again. Regexes are one alternation.
    """
    url: Column = F.col(column)
    direct = F.lit(False)
    small = len(patterns.domains) + len(patterns.urls) <= BROADCAST_PATTERNS
    if patterns.urls:
        full = urls.sparkSession.createDataFrame([(u,) for u in sorted(set(patterns.urls))], "__url string").withColumn("__full", F.lit(True))
        urls = urls.join(F.broadcast(full) if small else full, url == F.col("__url"), "left").drop("__url")
        direct = F.col("__full").isNotNull()
    if patterns.regexes:
        direct = direct | url.rlike("|".join(f"(?:{p})" for p in patterns.regexes))
    table = _domain_table(urls.sparkSession, patterns)
    # One regular expression per URL; user and port are rare, and cut off each distinct authority.
    urls = urls.withColumn("__at", C.authority(url))
    hosts = urls.select("__at").distinct().withColumn("__host", C.authority_host(F.col("__at")))
    suffixes = hosts.select("__at", F.explode(C.host_suffixes(F.col("__host"))).alias("domain"))
    side = F.broadcast(table) if small else table
    hit = written(suffixes.join(side, "domain", "left_semi").select("__at").distinct().withColumn("__hit", F.lit(True)), "hosts")
    joined = urls.join(hit, "__at", "left")
    return joined.withColumn("matched", F.coalesce(F.col("__hit"), F.lit(False)) | F.coalesce(direct, F.lit(False))).drop("__at", "__hit", "__full")


def rewrite_hops(outlinks: DataFrame, patterns: DomainPatterns, max_hops: int) -> DataFrame:
    """Outlinks in the crawled domains start again at hop 0; others go on while their parent is below max_hops.

    outlinks: url, hops (of the outlink). Column matched is consumed.
    """
    if not patterns:
        return outlinks.where(F.col("hops") <= max_hops)
    found = matched(outlinks, patterns)
    return found.where(F.col("matched") | (F.col("hops") <= max_hops)).withColumn("hops", F.when(F.col("matched"), 0).otherwise(F.col("hops"))).drop("matched")
