"""What a crawl carries from round to round: the queue and the seen-set, as tables with the range of their rows.

A round reads the tables that its own range meets, so it costs its own rows and not those of all rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.operators import seen

Keep = Callable[[DataFrame, str], DataFrame]

#: Tables of the seen-set that are merged into one.
FAN = 16


#: What tells rows apart, in the order in which they are taken: an address with a scheme doesn't depend on its parent.
_ORDER = ("hops", "raw", "kind", "redirects", "under")


def _under() -> Column:
    return F.when(~F.coalesce(F.col("raw").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(False)), F.col("parent"))


def _key() -> Column:
    """The place of a row as a struct that Python orders as Spark does: strings by their bytes, nulls first (_plain)."""
    return F.struct("hops", F.col("raw").cast("binary"), F.col("kind").cast("binary"), "redirects", _under().cast("binary"))


def _plain(key: tuple) -> tuple:
    return tuple((v is not None, bytes(v) if isinstance(v, bytearray) else v) for v in key)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


@dataclass(frozen=True, eq=False)
class _Slice:
    table: DataFrame
    rows: int
    first: tuple
    last: tuple


class Waiting:
    """Rows that wait for their round, taken in order of hops and address.

    Rows that are added are cut, where they are too many for one round, into slices of a sorted table. A round
    takes a slice that no other overlaps as it is; slices that overlap at the head of the queue are merged and cut
    anew, and the others stay where they are.
    """

    def __init__(self, spark: SparkSession, keep: Keep, schema: str) -> None:
        self.keep, self.number, self.slices = keep, 0, list[_Slice]()
        self.none = spark.createDataFrame([], schema)

    @property
    def rows(self) -> int:
        """An upper bound: a row that was added twice counts until its slices are taken."""
        return sum(s.rows for s in self.slices)

    def table(self) -> DataFrame:
        return self._once(_union([self.none, *(s.table for s in self.slices)]))

    def _once(self, rows: DataFrame) -> DataFrame:
        """Of rows that lead to one fetch the one with the least parent."""
        others = F.struct("parent", *(c for c in self.none.columns if c not in (*_ORDER, "parent")))
        least = rows.withColumn("under", _under()).groupBy(*_ORDER).agg(F.min(others).alias("least"))
        return least.select(*_ORDER, "least.*").select(self.none.columns)

    def add(self, rows: DataFrame, size: int) -> list[_Slice]:
        """Rows join the queue, once each, in slices of `size`, which are returned in order."""
        self.number += 1
        table = self.keep(self._once(rows), f"queue-{self.number}")
        n, first, last = table.agg(F.count("*"), F.min(_key()), F.max(_key())).first()
        new = self._cut(table, size) if n > size else [_Slice(table, n, _plain(first), _plain(last))] if n else []
        self.slices += new
        return new

    def _cut(self, table: DataFrame, size: int) -> list[_Slice]:
        run = self.keep(table.withColumn("under", _under()).orderBy(*_ORDER).drop("under").withColumn("__id", F.monotonically_increasing_id()), f"sorted-{self.number}")
        # An id is the number of a file and that of a row in it; files are in order.
        counts = dict(sorted(tuple(r) for r in run.groupBy(F.shiftright("__id", 33).alias("file")).count().collect()))
        start, total = {}, 0
        for file, n in counts.items():
            start[file], total = total, total + n

        def spans(low: int, high: int) -> list[tuple[int, int]]:
            """First and last id in each file of the rows low to high - 1."""
            return [((f << 33) + max(low - s, 0), (f << 33) + min(high - s, counts[f]) - 1) for f, s in start.items() if s < high and s + counts[f] > low]

        cuts = [spans(low, min(low + size, total)) for low in range(0, total, size)]
        ends = {i for c in cuts for i in (c[0][0], c[-1][1])}
        keys = {i: _plain(k) for i, k in run.where(F.col("__id").isin(*ends)).select("__id", _key()).collect()}
        within = lambda c: reduce(lambda a, b: a | b, [F.col("__id").between(*span) for span in c])
        return [_Slice(run.where(within(c)).drop("__id"), sum(b - a + 1 for a, b in c), keys[c[0][0]], keys[c[-1][1]]) for c in cuts]

    def take(self, size: int) -> DataFrame:
        """The first `size` rows, which leave the queue; all if there are no more."""
        chosen, n = self.slices, 0
        for s in sorted(self.slices, key=lambda s: s.last):
            n += s.rows
            if n >= size:
                chosen = [x for x in self.slices if x.first <= s.last]
                break
        self.slices = [s for s in self.slices if s not in chosen]
        if sum(s.rows for s in chosen) > size:
            chosen = self.add(_union([s.table for s in chosen]), size)[:1]
            self.slices.remove(chosen[0])
        return chosen[0].table if len(chosen) == 1 else self._once(_union([s.table for s in chosen]))


class Seen:
    """The seen-set as a log of the rounds' tables (url, kind); FAN of one level are merged into one of the next."""

    def __init__(self, spark: SparkSession, keep: Keep) -> None:
        self.keep, self.merged = keep, 0
        self.none = spark.createDataFrame([], "url string, kind string")
        self.levels: list[list[tuple[DataFrame, str, str]]] = []

    def add(self, table: DataFrame, low: str | None, high: str | None, level: int = 0) -> None:
        """A table whose URLs are all between low and high; both are null if there are none."""
        if low is None:
            return
        if level == len(self.levels):
            self.levels.append([])
        here = self.levels[level]
        here.append((table, low, high))
        if len(here) == FAN:
            self.levels[level] = []
            self.merged += 1
            one = seen.merge(self.none, _union([t for t, _, _ in here])).orderBy("url")
            self.add(self.keep(one, f"seen-{self.merged}"), min(a for _, a, _ in here), max(b for _, _, b in here), level + 1)

    def within(self, low: str | None, high: str | None) -> DataFrame:
        """Rows with URLs between low and high; a URL may have several."""
        met = [t for level in self.levels for t, a, b in level if low is not None and a <= high and low <= b]
        return _union(met).where(F.col("url").between(low, high)) if met else self.none

    def table(self) -> DataFrame:
        """One row per URL, a seed before an asset."""
        return seen.merge(self.none, _union([self.none, *(t for level in self.levels for t, _, _ in level)]))
