"""Structured Streaming forms of the stateful operators: seen-set, token buckets, rates.

State is kept per key, so it is spread like the keys; the seen-set's keys are URLs (no hot key can
grow: a URL's state is one word), the buckets' keys are hosts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dredge.operators.ratelimit import Bucket, fresh
from dredge.sources.lists import list_lines


def seen_stream(urls: DataFrame) -> DataFrame:
    """Stream of (url, kind) -> (url, kind, verdict): keep, promote or seen, in the order of arrival."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rank = state.get[0] if state.exists else -1
        out = []
        for pdf in parts:
            for kind in pdf["kind"]:
                mine = 1 if kind == "seed" else 0
                verdict = "keep" if rank < 0 else "promote" if rank == 0 and mine == 1 else "seen"
                rank = max(rank, mine)
                out.append((key[0], kind, verdict))
        state.update((rank,))
        yield pd.DataFrame(out, columns=["url", "kind", "verdict"])

    return urls.groupBy("url").applyInPandasWithState(step, "url string, kind string, verdict string", "rank int", "append", GroupStateTimeout.NoTimeout)


def bucket_stream(requests: DataFrame, capacity: float = 150.0, rate: float = 50.0, idle_ms: int = 300_000) -> DataFrame:
    """Stream of (host, ts seconds, code, seq) -> the time each request may start and the bucket after it.

    A host that was idle for idle_ms is forgotten, as the stale buckets of a crawler are.
    """
    schema = "host string, seq long, start double, tokens double, rate double, failures int"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(*state.get) if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        out = []
        for ts, code, seq in zip(rows["ts"], rows["code"], rows["seq"], strict=True):
            bucket = bucket or fresh(capacity, rate, ts)
            start = bucket.start(ts)
            bucket.answer(int(code), start)
            out.append((key[0], seq, start, bucket.tokens, bucket.rate, bucket.failures))
        state.update((bucket.capacity, bucket.ideal, bucket.tokens, bucket.rate, bucket.last, bucket.penalty_until, bucket.failures))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["host", "seq", "start", "tokens", "rate", "failures"])

    kept = "capacity double, ideal double, tokens double, rate double, last double, penalty_until double, failures int"
    return requests.groupBy("host").applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def rate_stream(events: DataFrame, ts: str, *keys: str, every: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Events per tumbling window and key; windows close `late` behind the newest event."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every)["start"].alias("start"), *keys).agg(F.count("*").alias("n"))


def sliding_stream(events: DataFrame, ts: str, size: str, step: str, *keys: str, late: str = "10 seconds") -> DataFrame:
    """Sliding windows, an extension: the crawler itself only has one-second rates."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, step).alias("w"), *keys).agg(F.count("*").alias("n"))


def session_stream(events: DataFrame, ts: str, gap: str, *keys: str, late: str = "10 seconds") -> DataFrame:
    """Events per session of a key: a session ends when nothing comes for `gap`."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))


def url_stream(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    """Stream of the URLs (value) of list files that appear in a folder, at most `files` of them a micro-batch."""
    return list_lines(spark.readStream.option("maxFilesPerTrigger", files).text(folder))


class Pausable:
    """A query that can be paused: it is stopped, and starts again from its checkpoint."""

    def __init__(self, start: Callable[[], StreamingQuery]) -> None:
        self._start = start
        self.query: StreamingQuery | None = start()

    @property
    def paused(self) -> bool:
        return self.query is None

    def pause(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None

    def resume(self) -> None:
        if self.query is None:
            self.query = self._start()


def producer(stream: DataFrame, add: Callable[[DataFrame, int], None], every: str = "1 second", checkpoint: str | None = None):
    """Hand micro-batches of discovered URLs to `add`, at most one each `every`."""
    writer = stream.writeStream.foreachBatch(add).trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
