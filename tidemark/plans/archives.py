"""Archive lists: validation, geometry, and the choice of the archive that answers a range."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import InvalidTime, propagation_unit, roundup

HEADER_BYTES, ARCHIVE_BYTES = 24, 12


class InvalidArchives(ValueError):
    """An archive list that breaks a rule."""


@dataclass(frozen=True)
class Archive:
    step: int
    count: int

    @property
    def retention(self) -> int:
        return self.step * self.count


def archives(pairs) -> list[Archive]:
    return [a if isinstance(a, Archive) else Archive(*a) for a in pairs]


def faults(pairs, xff: float) -> list[str]:
    """The rules that a list breaks, finest archive first: none, equal steps, steps that don't divide, no longer cover, too few points for one unit."""
    ordered = sorted(archives(pairs), key=lambda a: a.step)
    if not ordered:
        return ["empty"]
    found = []
    for fine, coarse in zip(ordered, ordered[1:], strict=False):
        if fine.step == coarse.step:
            found.append("repeated")
        elif coarse.step % fine.step:
            found.append("indivisible")
        if coarse.retention <= fine.retention:
            found.append("coverage")
        if fine.count / xff < coarse.step / fine.step:
            found.append("points")
    return found


def validated(pairs, xff: float) -> list[Archive]:
    if found := faults(pairs, xff):
        raise InvalidArchives(", ".join(found))
    return sorted(archives(pairs), key=lambda a: a.step)


def units(pairs, xff: float) -> list[int]:
    """The propagation unit from each archive to the next."""
    a = archives(pairs)
    return [propagation_unit(f.step, c.step, xff) for f, c in zip(a, a[1:], strict=False)]


def max_retention(pairs) -> int:
    return archives(pairs)[-1].retention


def array_of(pairs) -> Column:
    """The list as a literal array of structs."""
    return F.array(*[F.struct(F.lit(i).alias("archive"), F.lit(a.step).cast("bigint").alias("step"), F.lit(a.count).cast("bigint").alias("count")) for i, a in enumerate(archives(pairs))])


def frame(spark: SparkSession, pairs) -> DataFrame:
    return spark.createDataFrame([(i, a.step, a.count) for i, a in enumerate(archives(pairs))], "archive int, step bigint, count bigint")


@dataclass(frozen=True)
class Range:
    """What a fetch reads: an archive, and whole slots [start, until)."""

    archive: int
    step: int
    start: int
    until: int


def plan_fetch(pairs, start: int, until: int | None, now: int) -> Range | None:
    """The finest archive that reaches back to ``start``; None where the range and the retention don't meet.

    Both ends are rounded up to whole slots. Archives are never merged.
    """
    a = archives(pairs)
    until = now if until is None else until
    if start >= until:
        raise InvalidTime(f"from {start} isn't before until {until}")
    oldest = now - a[-1].retention
    if start > now or until < oldest:
        return None
    start, until = max(start, oldest), min(until, now)
    chosen = next((i for i, x in enumerate(a) if x.retention >= now - start), len(a) - 1)
    step = a[chosen].step
    return Range(chosen, step, roundup(start, step), roundup(until, step))


def geometry(list_: DataFrame, tag_bytes: int, values: int) -> DataFrame:
    """Offsets and sizes of archives in a packed file: ``archive, step, count, offset, size, retention``."""
    point = 4 + 8 * values
    sized = list_.withColumn("size", F.col("count") * point)
    total = F.count("*").over(Window.partitionBy(F.lit(0)))
    before = Window.partitionBy(F.lit(0)).orderBy("archive").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.lit(HEADER_BYTES + tag_bytes) + total * ARCHIVE_BYTES + F.coalesce(F.sum("size").over(before), F.lit(0))
    return sized.select("archive", "step", "count", offset.cast("bigint").alias("offset"), "size", (F.col("step") * F.col("count")).alias("retention"))


def schema_change(old: dict, new: dict) -> str:
    """``none``, ``meta`` (aggregate or factor) or ``rebuild`` (retentions)."""
    if archives(old["archives"]) != archives(new["archives"]):
        return "rebuild"
    return "meta" if (old["agg"], float(old["xff"])) != (new["agg"], float(new["xff"])) else "none"
