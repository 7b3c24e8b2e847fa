"""The core dataflow: align, dedupe, route, upsert, downsample, fetch.

Points are long: ``metric, ts, value`` and, where arrival matters, ``seq``. Every operator is one shuffle at
most, on (metric, slot) or finer, with partial aggregation before it; nothing is collected but single numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..functions.scalars import ring_slot, roundup, slot_floor
from ..plans.archives import Range, archives, array_of, plan_fetch, units


def align(points: DataFrame, step: int) -> DataFrame:
    return points.withColumn("slot_ts", slot_floor(F.col("ts"), step))


def slot_last_wins(points: DataFrame, step: int, order: list[str]) -> DataFrame:
    """One value per metric and slot: the last by ``order``, as a write buffer keeps it; one column of order is hashed, not sorted."""
    return align(points, step).groupBy("metric", "slot_ts").agg(F.max_by("value", F.col(order[0]) if len(order) == 1 else F.struct(*order)).alias("value"))


def slot_max_wins(points: DataFrame, step: int) -> DataFrame:
    """One value per metric and slot: the greatest, as one batch of an update keeps it."""
    return align(points, step).groupBy("metric", "slot_ts").agg(F.max("value").alias("value"))


def vector_max_wins(rows: DataFrame, step: int) -> DataFrame:
    """The same for ``ts, vals``: the lexicographically greatest vector of each slot."""
    return align(rows, step).groupBy("slot_ts").agg(F.max("vals").alias("vals"))


def route(points: DataFrame, list_, now: int) -> DataFrame:
    """Adds ``archive, step``: the finest archive whose retention reaches the point; points older than all are dropped.

    A point exactly as old as a retention stays in it; points of the future go to the finest.
    """
    fits = F.filter(array_of(list_), lambda a: a["step"] * a["count"] >= F.lit(now) - F.col("ts"))
    hit = F.try_element_at(fits, F.lit(1))
    return points.withColumn("archive", hit["archive"]).withColumn("step", hit["step"]).filter(F.col("archive").isNotNull())


def dropped(points: DataFrame, list_, now: int) -> DataFrame:
    """The points that ``route`` drops."""
    return points.filter(F.lit(now) - F.col("ts") > max(a.retention for a in archives(list_)))


def ring_survivors(rows: DataFrame, step: int, count: int, by: tuple[str, ...] = ("metric",), seq: str = "seq") -> DataFrame:
    """What a ring of ``count`` slots holds: the last write of each place, older or newer in time.

    A partial aggregate by place; no window over a metric's whole history.
    """
    kept = [c for c in rows.columns if c not in by]
    last = F.max_by(F.struct(*kept), F.struct(seq, "slot_ts"))
    return rows.groupBy(*by, ring_slot(F.col("slot_ts"), step, count).alias("ring")).agg(last.alias("kept")).select(*by, "ring", "kept.*")


def downsample(fine: DataFrame, low: int, agg: str, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Coarse slots from the next finer level; nulls don't count, a slot of nulls alone is null."""
    return fine.groupBy(*by, slot_floor(F.col("slot_ts"), low).alias("low_ts")).agg(aggregate(agg, F.col("value"), F.col("slot_ts")).alias("value")).withColumnRenamed("low_ts", "slot_ts")


def complete(fine: DataFrame, unit: int, gate: tuple[str, ...] = ()) -> DataFrame:
    """Only slots of whole units: before the last unit boundary at or under the newest slot.

    The newest slot is taken over all metrics of a file (``gate``), or over all rows: a busy metric
    completes a quiet neighbour's units.
    """
    for c in (*gate, "slot_ts"):  # what the join would ask of one side alone
        fine = fine.filter(F.col(c).isNotNull())
    newest = fine.groupBy(*gate).agg(slot_floor(F.max("slot_ts"), unit).alias("upto"), F.count("value").alias("_n")).filter("_n >= 0").drop("_n")  # reads what ``fine`` does, so that Spark makes it once
    joined = fine.join(newest, list(gate)) if gate else fine.join(F.broadcast(newest))  # without a gate: one row
    return joined.filter("slot_ts < upto").drop("upto")


def cascade(finest: DataFrame, list_, xff: float, agg: str, gate: tuple[str, ...] = (), by: tuple[str, ...] = ("metric",)) -> list[DataFrame]:
    """All levels, each from the one before and from complete units alone; level 0 is given."""
    levels, a = [finest], archives(list_)
    for unit, coarse in zip(units(a, xff), a[1:], strict=True):
        levels.append(downsample(complete(levels[-1], unit, gate), coarse.step, agg, (*gate, *by)))
    return levels


def retained(level: DataFrame, retention: int, now: int) -> DataFrame:
    return level.filter(F.col("slot_ts") >= F.lit(now - retention))


def grid(spark: SparkSession, range_: Range) -> DataFrame:
    """Every slot of a range as ``ts``; none for an empty range."""
    return spark.range(range_.start, max(range_.start, range_.until), range_.step).withColumnRenamed("id", "ts")


def dense(level: DataFrame, metrics: DataFrame, range_: Range) -> DataFrame:
    """``metric, ts, step, value`` for every metric and slot of a range; null where nothing is stored.

    Slots are generated per metric on its own row, so that the grid is partitioned like the metrics, and the stored
    slots are filtered by range before the join.
    """
    if range_.start >= range_.until:
        slots = metrics.select("metric", F.lit(0).cast("bigint").alias("ts")).limit(0)
    else:
        every = F.sequence(*[F.lit(x).cast("bigint") for x in (range_.start, range_.until - range_.step, range_.step)])
        slots = metrics.select("metric", F.explode(every).alias("ts"))
    stored = level.filter((F.col("slot_ts") >= range_.start) & (F.col("slot_ts") < range_.until)).select("metric", F.col("slot_ts").alias("ts"), "value")
    return slots.join(stored, ["metric", "ts"], "left").select("metric", "ts", F.lit(range_.step).cast("bigint").alias("step"), "value")


def fetch(levels: list[DataFrame], list_, start: int, until: int | None, now: int, metrics: DataFrame) -> DataFrame | None:
    """A dense series from the archive that ``plan_fetch`` chooses; None where there is nothing to read."""
    range_ = plan_fetch(list_, start, until, now)
    return None if range_ is None else dense(levels[range_.archive], metrics, range_)


def merge_series(points: DataFrame, names: list[str], order: str = "seq") -> DataFrame:
    """Series side by side, one row per time stamp: ``ts`` and a column per name; of repeated ones the last counts."""
    own = points.filter((F.col("ts") != 0) & F.col("metric").isin(names))
    last = [F.max_by("value", F.when(F.col("metric") == n, F.col(order))).alias(n) for n in names]
    return own.groupBy("ts").agg(*last)


def merge_vectors(points: DataFrame, names: list[str], order: str = "seq") -> DataFrame:
    return merge_series(points, names, order).select("ts", F.array(*[F.col(f"`{n}`") for n in names]).alias("vals"))


def fill_gaps(series: DataFrame, step: int, count: int) -> DataFrame:
    """Every slot from each metric's first to its last, nulls where missing, the first ``count`` of them; all given points stay."""
    ends = series.groupBy("metric").agg(F.min("slot_ts").alias("low"), F.max("slot_ts").alias("high"))
    top = F.least(F.col("high"), F.col("low") + step * (count - 1))
    slots = ends.select("metric", F.explode(F.sequence("low", top, F.lit(step).cast("bigint"))).alias("slot_ts"))
    return slots.join(series, ["metric", "slot_ts"], "left").select("metric", "slot_ts", "value")


def gaps(series: DataFrame, step: int) -> DataFrame:
    """Slots that don't follow the metric's slot before: ``metric, slot_ts, expected``."""
    before = F.lag("slot_ts").over(Window.partitionBy("metric").orderBy("slot_ts"))
    return series.withColumn("expected", before + step).filter(F.col("slot_ts") != F.col("expected")).select("metric", "slot_ts", "expected")


def first_gap(series: DataFrame, step: int, start: int = 0) -> DataFrame:
    """Each metric's first place, counted from ``start``, whose slot isn't the expected one: ``metric, position``."""
    order = Window.partitionBy("metric").orderBy("slot_ts")
    placed = series.withColumn("position", F.row_number().over(order) - 1).withColumn("expected", F.lag("slot_ts").over(order) + step)
    return placed.filter((F.col("slot_ts") != F.col("expected")) & (F.col("position") > start)).groupBy("metric").agg(F.min("position").alias("position"))


def runs(series: DataFrame, step: int) -> DataFrame:
    """Islands of consecutive slots: ``metric, start_ts, end_ts, points``."""
    island = F.col("slot_ts") - F.row_number().over(Window.partitionBy("metric").orderBy("slot_ts")) * step
    return series.withColumn("island", island).groupBy("metric", "island").agg(F.min("slot_ts").alias("start_ts"), F.max("slot_ts").alias("end_ts"), F.count("*").alias("points")).drop("island")


def point_at(series: DataFrame, position: int) -> DataFrame:
    """Each metric's point at a place in time order, negative from the end: ``metric, slot_ts, value``."""
    order = Window.partitionBy("metric").orderBy("slot_ts" if position >= 0 else F.desc("slot_ts"))
    nth = position + 1 if position >= 0 else -position
    return series.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") == nth).select("metric", "slot_ts", "value")


def stitch(stored: DataFrame, hot: DataFrame) -> DataFrame:
    """Stored and buffered points of (metric, ts), of which the buffered one counts."""
    both = stored.select("metric", "ts", "value", F.lit(0).alias("source")).unionByName(hot.select("metric", "ts", "value", F.lit(1).alias("source")))
    return both.groupBy("metric", "ts").agg(F.max_by("value", "source").alias("value"))


def latest_first(points: DataFrame) -> DataFrame:
    return points.orderBy(F.desc("ts"), "metric")


def settled_range(start: int, until: int, step: int) -> Range:
    return Range(0, step, roundup(start, step), roundup(until, step))
