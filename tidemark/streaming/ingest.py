"""Streams into the store, and a buffer of recent points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import slot_floor
from ..sources.store import Store
from ..sources.text import explode_batches, parse_lines


def socket_lines(spark: SparkSession, host: str, port: int | None) -> DataFrame | None:
    """Points of a line-protocol listener; none where the port is unset."""
    return parse_lines(_lines(spark, host, port)) if port else None


def _lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def socket_batches(spark: SparkSession, host: str, port: int | None) -> DataFrame | None:
    """Points of a batch listener, whose lines are JSON ``{"points": [{"metric", "ts", "value"}]}``; none where the port is unset."""
    if not port:
        return None
    parsed = _lines(spark, host, port).select(F.from_json("value", "points array<struct<metric:string,ts:string,value:string>>").alias("j"))
    return explode_batches(parsed.select(F.col("j.points").alias("points")))


def answers(asked: DataFrame, buffer: DataFrame, step: int, now: int) -> DataFrame:
    """Buffered points for a stream or table of metric names ``value``: ``metric, ts, value`` before the slot that ``now`` is in."""
    hot = buffer.filter((F.col("slot_ts") < slot_floor(F.lit(now), step)) & F.col("value").isNotNull()).select("metric", F.col("slot_ts").alias("ts"), "value")
    return asked.select(F.trim("value").alias("metric")).join(hot, "metric")


def socket_queries(spark: SparkSession, host: str, port: int, buffer: DataFrame, step: int, now: int) -> DataFrame:
    """Answers to a query listener's lines, each of which names a metric."""
    return answers(_lines(spark, host, port), buffer, step, now)


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.readStream.text(path))


def ingest(points: DataFrame, store: Store, checkpoint: str, settle: bool = True, handlers: tuple[Callable[[DataFrame, int], None], ...] = (), every: str | None = None, now: Callable[[], int] | None = None) -> StreamingQuery:
    """Write every micro-batch to the store, then derive coarser levels of the schemas it touched; ``handlers`` see each batch too.

    A batch's number is its write number, so that a batch that runs again counts once. Arrival goes by the points' ``seq``;
    without it, by their order in the batch. With ``now``, a clock, points are routed by age. A handler that fails is
    logged and doesn't stop the others. Without ``every`` what is there is drained and the query ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = (batch if "seq" in batch.columns else batch.withColumn("seq", F.monotonically_increasing_id())).persist()
        try:
            store.append(held, number, now() if now else None)
            for name, since in store.touched(held).items() if settle else ():
                store.settle(name, number, since)
            for handler in handlers:
                try:
                    handler(held, number)
                except Exception as e:  # noqa: BLE001
                    print(f"handler failed: {e}")
        finally:
            held.unpersist()

    writer = points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def buffered(points: DataFrame, step: int, retention: int, wait: int = 10) -> DataFrame:
    """The write buffer as a stream of ``metric, ts, value, seq``: of each slot the last arrival, by ``seq``, given out when the slot is ``retention + wait`` seconds old."""
    timed = points.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", f"{retention + wait} seconds")
    window = F.window("at", f"{step} seconds")
    return timed.groupBy("metric", window.alias("w")).agg(F.max_by("value", "seq").alias("value")).select("metric", F.unix_seconds("w.start").alias("slot_ts"), "value")


def hot_read(buffer: DataFrame, metric: str, step: int, now: int) -> DataFrame:
    """Buffered points of a metric before the slot that ``now`` is in."""
    return buffer.filter((F.col("metric") == metric) & (F.col("slot_ts") < slot_floor(F.lit(now), step)) & F.col("value").isNotNull()).select(F.col("slot_ts").alias("ts"), "value").orderBy("ts")


def flushable(files: DataFrame, now: int, wait: int = 10) -> DataFrame:
    """Buffers that are due: ``start_ts, retention`` rows whose first slot has waited long enough."""
    return files.filter(F.lit(now) - F.col("start_ts") - F.col("retention") >= wait)


class TokenBucket:
    """At most ``capacity`` at once, refilled by ``rate`` a second."""

    def __init__(self, capacity: float, rate: float, now: float, tokens: float | None = None):
        self.capacity, self.rate, self.at, self.tokens = capacity, rate, now, capacity if tokens is None else tokens

    def take(self, n: float, now: float) -> bool:
        self.tokens = min(self.capacity, self.tokens + max(0.0, now - self.at) * self.rate)
        self.at = max(self.at, now)
        if n > self.tokens:
            return False
        self.tokens -= n
        return True


def admitted(creations: DataFrame, per_minute: int) -> DataFrame:
    """A stream of ``instance, ts, metric`` with ``admitted``: one token bucket per instance, by event time."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (float(per_minute), None)
        for frame in frames:
            frame = frame.sort_values(["ts", "metric"])
            bucket = TokenBucket(per_minute, per_minute / 60, frame.ts.iloc[0] if at is None else at, tokens)
            frame["admitted"] = [bucket.take(1, ts) for ts in frame.ts]
            tokens, at = bucket.tokens, bucket.at
            yield frame[["instance", "ts", "metric", "admitted"]]
        state.update((float(tokens), float(at)))

    return creations.select("instance", "ts", "metric").groupBy("instance").applyInPandasWithState(step, "instance int, ts bigint, metric string, admitted boolean", "tokens double, at double", "append", "NoTimeout")
