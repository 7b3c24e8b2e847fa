"""Batch updates of one file: exact semantics of a write with its propagation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..functions.scalars import propagation_unit, ring_slot, roundup
from ..plans.archives import Archive, Range, archives, plan_fetch
from .timeline import route, vector_max_wins

STATE = "archive int, slot_ts bigint, pos int, value double"


def propagation_range(start: int, until: int, high: int, low: int, xff: float) -> tuple[int, int] | None:
    """Which span of the finer archive a write of [start, until] propagates; None where no unit is complete.

    Nothing happens while both ends lie in one unit, unless the start is at its boundary.
    """
    unit = propagation_unit(high, low, xff)
    if start // unit == until // unit and start % unit:
        return None
    if low <= unit:
        end = until // unit * unit
        return min(end - unit, start // unit * unit), end
    return start // low * low, roundup(until, low)


class File:
    """The archives of one file of N metrics as a table; each update gives a new table.

    ``checkpoint`` may cut lineage after an update: a function from frame to frame.
    """

    def __init__(self, spark: SparkSession, tags: list[str], list_, xff: float, agg: str, checkpoint=None):
        self.spark, self.tags, self.archives, self.xff, self.agg = spark, tags, archives(list_), xff, agg
        self.checkpoint = checkpoint or (lambda df: df)
        self.state = spark.createDataFrame([], STATE)

    def _write(self, i: int, rows: DataFrame) -> None:
        """Rows (slot_ts, pos, value) replace whatever their ring places held; of rows for one place the newest slot does."""
        a: Archive = self.archives[i]
        ring = ring_slot(F.col("slot_ts"), a.step, a.count)
        rows = rows.groupBy(ring.alias("ring"), "pos").agg(F.max(F.struct("slot_ts", "value")).alias("kept")).select("pos", "kept.*")
        taken = rows.select(F.lit(i).alias("archive"), ring.alias("ring")).distinct()
        kept = self.state.withColumn("ring", F.when(F.col("archive") == i, ring)).join(taken, ["archive", "ring"], "left_anti").drop("ring")
        self.state = self.checkpoint(kept.unionByName(rows.withColumn("archive", F.lit(i))))

    def update(self, points: DataFrame, now: int, mtime: int | None = None) -> None:
        """Write ``ts, vals``; ``mtime``, the time of the last write, extends what is propagated backwards."""
        routed = route(points, self.archives, now)
        ends = {r.archive: (r.low, r.high) for r in routed.groupBy("archive").agg(F.min("ts").alias("low"), F.max("ts").alias("high")).collect()}  # one row an archive
        for i in sorted(ends):
            step = self.archives[i].step
            rows = vector_max_wins(routed.filter(F.col("archive") == i), step).select("slot_ts", F.posexplode("vals").alias("pos", "value"))
            self._write(i, rows)
            low, high = ends[i]
            start = low if mtime is None else min(mtime, low)
            self._propagate(i, min(start, low // step * step), high)

    def _propagate(self, i: int, start: int, until: int) -> None:
        if i + 1 >= len(self.archives):
            return
        high, low = self.archives[i], self.archives[i + 1]
        span = propagation_range(start, until, high.step, low.step, self.xff)
        if span is None or span[0] >= span[1]:
            return
        begin, end = span
        fine = self.state.filter((F.col("archive") == i) & (F.col("slot_ts") >= begin) & (F.col("slot_ts") < end))
        found = fine.groupBy((F.floor(F.col("slot_ts") / low.step) * low.step).cast("bigint").alias("slot_ts"), "pos").agg(aggregate(self.agg, F.col("value"), F.col("slot_ts")).alias("value"))
        first = math.floor(begin / low.step) * low.step
        every = self.spark.range(first, end, low.step).select(F.col("id").alias("slot_ts"), F.explode(F.sequence(F.lit(0), F.lit(len(self.tags) - 1))).alias("pos"))
        self._write(i + 1, every.join(found, ["slot_ts", "pos"], "left").filter("slot_ts <> 0"))
        self._propagate(i + 1, min(begin, first), max(end, until))

    def fetch(self, start: int, until: int | None, now: int) -> tuple[Range, DataFrame] | None:
        """The range read, and a dense ``metric, ts, step, value``."""
        range_ = plan_fetch(self.archives, start, until, now)
        if range_ is None:
            return None
        tags = self.spark.createDataFrame(list(enumerate(self.tags)), "pos int, metric string")
        slots = self.spark.range(range_.start, max(range_.start, range_.until), range_.step).withColumnRenamed("id", "slot_ts").join(F.broadcast(tags))  # tags: one file's
        stored = self.state.filter((F.col("archive") == range_.archive) & (F.col("slot_ts") >= range_.start) & (F.col("slot_ts") < range_.until)).drop("archive")
        return range_, slots.join(stored, ["slot_ts", "pos"], "left").select("metric", F.col("slot_ts").alias("ts"), F.lit(range_.step).cast("bigint").alias("step"), "value")
