"""Sources of work: what a crawl needs of a queue, and a queue kept in the shared folder."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from dredge.operators import frontier, store
from dredge.schemas import FRONTIER


class FrontierSource(Protocol):
    """Start with `start`, end with `stop`; rows have the columns of schemas.FRONTIER."""

    name: str

    def start(self) -> None: ...
    def push(self, rows: DataFrame) -> None: ...
    def pull(self, n: int, now: int) -> DataFrame: ...
    def finish(self, ids: DataFrame) -> None: ...
    def stop(self, now: int) -> None: ...


class TableFrontier:
    """A queue of Parquet tables: every change is a new table, and the one before is left to those who read it.

    `finish` deletes what is done; an id that the queue doesn't have is an error. `stop` gives claimed rows back.
    """

    name = "table"

    def __init__(self, spark: SparkSession, rows: DataFrame | None = None) -> None:
        self.spark, self.first = spark, rows
        self.rows: DataFrame | None = None

    def start(self) -> None:
        self.rows = store.written(self.spark.createDataFrame([], FRONTIER), "frontier")
        if self.first is not None:
            self.push(self.first)

    def _put(self, rows: DataFrame) -> None:
        self.rows = store.written(rows.select([f.name for f in FRONTIER]), "frontier")

    def push(self, rows: DataFrame) -> None:
        self._put(self.rows.unionByName(frontier.add(self.rows, rows)))

    def pull(self, n: int, now: int) -> DataFrame:
        """The n best fresh rows, claimed."""
        picked = store.written(frontier.pick(self.rows, n), "picked")
        self._put(frontier.claim(self.rows, picked, now))
        return picked

    def finish(self, ids: DataFrame) -> None:
        unknown = frontier.absent(self.rows, ids).take(1)
        if unknown:
            raise KeyError(f"not in the queue: {unknown[0]['id']}")
        self._put(frontier.delete(self.rows, ids))

    def stop(self, now: int) -> None:
        self._put(frontier.reset(self.rows, frontier.in_flight(self.rows), now))
