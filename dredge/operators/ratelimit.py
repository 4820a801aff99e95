"""Adaptive token bucket per host: replayed in batch, or kept as state of a stream.

Bucket state is not linear in its events, so it is a fold over each host's events in order, not a
window aggregate. A host's events are one group; hosts are spread, a host is not (its requests are
in sequence by nature), and a group streams through the fold batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Least refill per second, penalty seconds at first and at most, share of recovery.
MIN_RATE, BASE_PENALTY, MAX_PENALTY, RECOVERY = 0.5, 5.0, 30.0, 0.1
PENALISED = (429, 403, 408, 425)


@dataclass
class Bucket:
    capacity: float
    ideal: float
    tokens: float
    rate: float
    last: float
    penalty_until: float = float("-inf")
    failures: int = 0

    def start(self, now: float) -> float:
        """Earliest time a request that is ready now can start; takes its token."""
        when = max(now, self.penalty_until if self.tokens < 1 else now)
        self._refill(when)
        if self.tokens < 1:
            when += (1 - self.tokens) / self.rate
            self._refill(when)
        self.tokens = max(0.0, self.tokens - 1)
        return when

    def _refill(self, now: float) -> None:
        if now < self.penalty_until:
            return
        elapsed = now - max(self.last, self.penalty_until)
        if elapsed > 0:
            self.tokens = min(self.capacity, self.tokens + elapsed * self.rate)
            self.last = now

    def answer(self, code: int, now: float) -> None:
        """Penalty for refusals, a lower rate for server errors, slow recovery otherwise."""
        if code in PENALISED:
            self.failures += 1
            self.penalty_until = now + min(BASE_PENALTY * 2 ** (self.failures - 1), MAX_PENALTY)
            self.tokens = 0.0
        elif code >= 500:
            self.failures += 1
            self.rate = max(self.rate * 0.5**self.failures, MIN_RATE)
            self.tokens = 0.0
        elif now > self.penalty_until:
            self.rate = min(self.ideal, self.rate + (self.ideal - self.rate) * RECOVERY)
            self.failures = max(0, self.failures - 1)


def fresh(capacity: float, rate: float, now: float) -> Bucket:
    return Bucket(capacity, rate, capacity, rate, now)


def replay(events: DataFrame, capacity: float = 150.0, rate: float = 50.0) -> DataFrame:
    """events (host, ts seconds, code, seq) in order of ts and seq -> start, tokens, rate, penalty_until, failures after each."""

    schema = "host string, seq long, ts double, code int, start double, tokens double, rate double, penalty_until double, failures int"
    # Sorted within partitions by host, so that each host's rows arrive in order, a batch at a time.
    ordered = events.select("host", "ts", "code", "seq").repartition("host").sortWithinPartitions("host", "ts", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        bucket: Bucket | None = None
        for batch in batches:
            out: list[tuple] = []
            for host, ts, code, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host,) != held:
                    held, bucket = (host,), fresh(capacity, rate, ts)
                start = bucket.start(ts)
                bucket.answer(int(code), start)
                until = bucket.penalty_until if bucket.penalty_until > float("-inf") else None
                out.append((host, seq, ts, int(code), start, bucket.tokens, bucket.rate, until, bucket.failures))
            types = [pa.string(), pa.int64(), pa.float64(), pa.int32(), *[pa.float64()] * 4, pa.int32()]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return ordered.mapInArrow(run, schema)
