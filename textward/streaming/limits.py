"""Limits on requests: a token bucket that is filled each period, a short queue behind it, and a number of calls at one time.

Periods begin at multiples of their length since the epoch. A request takes a token; without one it waits in the queue for the next
periods' tokens, which the queue gets first; where the queue is full it is rate_limited. With a token it needs one of `calls` places, and
waits for one no longer than `patience`, else it is concurrency_limited; it holds the place for its duration. Otherwise it is a success,
`wait` seconds after it came. Requests of a key are judged in order of time, then of `order`.

Three ways, with one result:

* `admitted()`: the bucket alone, over a table. What a period leaves in the queue is the sum before it, held between 0 and the queue's
  size, so only numbers of requests by period are gone through in order; requests themselves are judged by their rank in their
  period, and a busy key is dealt over its periods.
* `replayed()`: bucket and calls, over a table. A call's place depends on all calls before, so a key's requests are read in order by one
  task, a batch at a time; it keeps a few numbers.
* `limited()`: the same over a stream, with a few numbers of state for each key, dropped by a timer when they no longer tell anything.
  A row that comes after its period has passed is judged in the current one.

Rows with a null time are never successful: they get status rate_limited and a null wait. A null key is a key. A null or negative duration
counts as 0. Columns named status or wait are replaced. A stream drops rows behind its watermark, and null times with them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StringType, StructType

from textward.shipping import ship

SUCCESS, RATE, CALLS = "success", "rate_limited", "concurrency_limited"
SECOND = 1_000_000


@dataclass(frozen=True)
class Limits:
    """Tokens of a period (seconds), requests that wait, calls at one time, and seconds that a request waits for a call's place."""

    tokens: int = 10
    period: float = 1.0
    queue: int = 5
    calls: int | None = 5
    patience: float = 15.0

    def __post_init__(self) -> None:
        if self.tokens <= 0 or self.period <= 0 or self.queue < 0 or (self.calls is not None and self.calls <= 0):
            raise ValueError("limits must be positive")

    @property
    def micros(self) -> int:
        return round(self.period * SECOND)


@dataclass
class Bucket:
    """What is known of a key: the period, its tokens left, requests waiting, and when running calls end."""

    window: int | None = None
    tokens: int = 0
    waiting: int = 0
    ends: list[int] = field(default_factory=list)

    def ask(self, at: int, duration: int, limits: Limits) -> tuple[str, float | None]:
        period = limits.micros
        window = at // period
        if self.window is None:
            self.window, self.tokens = window, limits.tokens
        if window > self.window:
            left = max(0, self.waiting - limits.tokens * (window - self.window - 1))
            self.window, self.tokens, self.waiting = window, max(0, limits.tokens - left), max(0, left - limits.tokens)
        start = max(at, self.window * period)
        if self.tokens and not self.waiting:
            self.tokens -= 1
        elif self.waiting < limits.queue:
            start = (self.window + 1 + self.waiting // limits.tokens) * period
            self.waiting += 1
        else:
            return RATE, None
        if limits.calls is not None:
            while self.ends and self.ends[0] <= start:
                heapq.heappop(self.ends)
            if len(self.ends) >= limits.calls:
                if self.ends[0] - start > limits.patience * SECOND:
                    return CALLS, None
                start = heapq.heappop(self.ends)
            heapq.heappush(self.ends, start + max(0, duration))
        return SUCCESS, (start - at) / SECOND


def _micros(df: DataFrame, at: str) -> Column:
    """Since the epoch; times without a zone count as UTC."""
    if df.schema[at].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(at))
    return F.unix_micros(F.col(at))


def _kept(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("status", "wait")]


def admitted(df: DataFrame, key: str, at: str, order: str, limits: Limits) -> DataFrame:
    """df with status and wait, by the bucket alone."""
    ship(df.sparkSession)
    period, tokens, queue = limits.micros, limits.tokens, limits.queue
    rows = df.select(*_kept(df), _micros(df, at).alias("_at")).withColumn("_window", ((F.col("_at") - F.pmod("_at", F.lit(period))) / period).cast("long"))
    counts = rows.where(F.col("_window").isNotNull()).groupBy(F.col(key).alias("_key"), "_window").agg(F.count(F.lit(1)).alias("n"))

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, window, carry = object(), 0, 0
        for batch in batches:
            found = []
            for name, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != last:
                    last, carry = name, 0
                else:
                    carry = max(0, carry - tokens * (w - window - 1))
                found.append(carry)
                window, carry = w, min(queue, max(0, carry + n - tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["_key", "_window", "carry"])

    schema = StructType([counts.schema["_key"], counts.schema["_window"]]).add("carry", "long")
    carry = counts.repartition("_key").sortWithinPartitions("_key", "_window").mapInArrow(carried, schema)
    rank = F.row_number().over(Window.partitionBy(key, "_window").orderBy(at, order))
    ranked = rows.withColumn("_rank", rank).alias("r").join(carry.alias("c"), F.col(f"r.{key}").eqNullSafe(F.col("c._key")) & (F.col("r._window") == F.col("c._window")), "left")
    # of the queue that a period begins with, what its tokens do not serve waits on
    free, before = F.greatest(F.lit(0), F.lit(tokens) - F.col("carry")), F.greatest(F.lit(0), F.col("carry") - tokens)
    place = before + F.col("_rank") - free  # in the queue, from 1
    now = (F.col("_rank") <= free) & (before == 0)
    status = F.when(now | (place <= queue), SUCCESS).otherwise(RATE)
    served = (F.col("r._window") + 1 + F.floor((place - 1) / tokens)) * period
    wait = F.when(now, 0.0).when(place <= queue, (served - F.col("r._at")) / SECOND)
    null = F.col("r._window").isNull()
    return ranked.select(*[F.col(f"r.{c}").alias(c) for c in _kept(df)], F.when(null, RATE).otherwise(status).alias("status"), F.when(~null, wait).alias("wait"))


def replayed(df: DataFrame, key: str, at: str, order: str, limits: Limits, duration: str | None = None) -> DataFrame:
    """df with status and wait, by bucket and calls. `duration`: a column of seconds."""
    ship(df.sparkSession)
    kept = _kept(df)
    own = df.select(*kept, F.col(key).alias("_key"), _micros(df, at).alias("_at"), _duration(duration).alias("_duration"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket = object(), Bucket()
        for batch in batches:
            found = []
            for name, time, length in zip(*(batch.column(c).to_pylist() for c in range(len(kept), len(kept) + 3)), strict=True):
                if name != last:
                    last, bucket = name, Bucket()
                found.append((RATE, None) if time is None else bucket.ask(time, length, limits))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*kept, "status", "wait"])

    schema = StructType([df.schema[c] for c in kept]).add("status", "string").add("wait", "double")
    return own.repartition("_key").sortWithinPartitions("_key", "_at", order).mapInArrow(run, schema)


def _duration(duration: str | None) -> Column:
    return F.greatest(F.lit(0), F.coalesce(F.round(F.col(duration) * SECOND).cast("long"), F.lit(0))) if duration else F.lit(0)


class Limiter(StatefulProcessor):
    """limited()'s state for each key."""

    def __init__(self, limits: Limits, order: str, names: list[str]) -> None:
        self.limits, self.order, self.names = limits, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "window long, tokens long, waiting long, ends array<long>")

    def _bucket(self) -> Bucket:
        if not self.state.exists():
            return Bucket()
        window, tokens, waiting, ends = self.state.get()
        return Bucket(window, tokens, waiting, list(ends))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        bucket = self._bucket()
        for row in sorted(rows, key=lambda r: (r["_at"], r[self.order])):  # of one batch
            status, wait = bucket.ask(row["_at"], row["_duration"], self.limits)
            yield Row(**{c: row[c] for c in self.names}, status=status, wait=wait)
        self.state.update((bucket.window, bucket.tokens, bucket.waiting, bucket.ends))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self._told(bucket))

    def _told(self, bucket: Bucket) -> int:
        """When the bucket is as a fresh one, in milliseconds."""
        full = (bucket.window + 2 + bucket.waiting // self.limits.tokens) * self.limits.micros
        return max([full, *bucket.ends]) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(stream: DataFrame, key: str, at: str, order: str, limits: Limits, duration: str | None = None, late: str = "10 minutes") -> DataFrame:
    """A stream with status and wait. Needs the RocksDB state store."""
    ship(stream.sparkSession)
    kept = _kept(stream)
    own = stream.where(F.col(at).isNotNull()).withWatermark(at, late).select(*kept, F.col(key).alias("_key"), _micros(stream, at).alias("_at"), _duration(duration).alias("_duration"))
    schema = StructType([stream.schema[c] for c in kept]).add("status", StringType()).add("wait", DoubleType())
    return own.groupBy("_key").transformWithState(Limiter(limits, order, kept), schema, "Append", "EventTime")
