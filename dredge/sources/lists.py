"""Text sources: URL lists, exclusion files, domain pattern files, logfmt logs."""

from __future__ import annotations

import re
import urllib.request
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.schemas import FRONTIER


def list_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed lines that are neither empty nor comments."""
    trimmed = F.trim(F.regexp_replace(column, r"^\s+|\s+$", ""))
    return lines.withColumn(column, trimmed).where((F.col(column) != "") & ~F.col(column).startswith("#"))


#: Bytes of a list that is fetched from a server, at most; a longer one is an error.
REMOTE_BYTES = 64 << 20


def text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines (value) of files, and of lists that a server gives; those are small and go through the driver."""
    remote = [p for p in paths if re.match(r"(?i)https?://", p)]
    local = [p for p in paths if p not in remote]
    found = [spark.read.text(local)] if local else []
    for url in remote:
        with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
            body = answer.read(REMOTE_BYTES + 1)
        if len(body) > REMOTE_BYTES:
            raise ValueError(f"list of more than {REMOTE_BYTES} bytes: {url}")
        found.append(spark.createDataFrame([(x,) for x in body.decode("utf-8", "replace").splitlines()], "value string"))
    return reduce(DataFrame.unionByName, found)


def read_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """URLs of list files, on disk or on servers; at least one must be given."""
    if not paths:
        raise ValueError("no list given")
    return list_lines(text_lines(spark, paths))


def from_urls(spark: SparkSession, urls: list[str]) -> DataFrame:
    """URLs as given; one that can't be a request target is an error that stops the start."""
    for u in urls:
        if not re.match(r"([A-Za-z][A-Za-z0-9+.\-]*:|/)[^\s]*$", u):
            raise ValueError(f"not a URL: {u!r}")
    return spark.createDataFrame([(u,) for u in urls], "value string")


def to_frontier(urls: DataFrame, now: int = 0) -> DataFrame:
    """Fresh queue rows of hop 0; the id follows from the value, so a retry gives the same rows."""
    rows = urls.select(F.sha2("value", 256).alias("id"), "value", F.lit(None).cast("string").alias("via"), F.lit(0).alias("hops"), F.lit("FRESH").alias("status"), F.lit(now).cast("long").alias("timestamp"))
    return rows.dropDuplicates(["value"]).select([f.name for f in FRONTIER])


def read_exclusions(spark: SparkSession, paths: list[str], skip_broken: bool = False) -> tuple[str, ...]:
    """Regular expressions of exclusion files. One that doesn't compile fails the load; on a reload
    (skip_broken) its file is left out instead. Read again each round for live reload."""
    found: list[str] = []
    for path in paths:
        lines = [r["value"] for r in list_lines(text_lines(spark, [path])).collect()]
        try:
            for x in lines:
                re.compile(x)
        except re.error:
            if not skip_broken:
                raise
            continue
        found.extend(lines)
    return tuple(found)


def read_patterns(spark: SparkSession, paths: list[str]) -> list[str]:
    """Domain patterns, line by line as they are."""
    return [r["value"] for r in text_lines(spark, paths).collect()]


_PAIR = r'([A-Za-z_][A-Za-z0-9_.\-]*)=("(?:\\.|[^"\\])*"|[^\s"]*)'


def logfmt(lines: DataFrame, column: str = "value") -> DataFrame:
    """record (map) and duplicate of each log line that has level and time.

    duplicate marks lines that have a key twice, of which the first value counts.
    """
    keys = F.regexp_extract_all(column, F.lit(_PAIR), F.lit(1))
    raw = F.regexp_extract_all(column, F.lit(_PAIR), F.lit(2))
    values = F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('\\"'), F.lit('"'))).otherwise(x))
    pairs = lines.select("*", keys.alias("__k"), values.alias("__v"))
    distinct = F.array_distinct("__k")
    record = F.map_from_arrays(distinct, F.transform(distinct, lambda k: F.element_at("__v", F.array_position("__k", k).cast("int"))))
    parsed = pairs.select(*lines.columns, record.alias("record"), (F.size(distinct) < F.size("__k")).alias("duplicate"))
    return parsed.where(F.map_contains_key("record", "level") & F.map_contains_key("record", "time"))
