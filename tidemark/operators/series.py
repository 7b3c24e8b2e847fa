"""The life of files and series: creation, tags, changes of metadata, flushes of write buffers, and files merged from series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import slot_floor
from ..plans.archives import archives, array_of, max_retention
from .timeline import fill_gaps, merge_vectors

#: Room that a new file's header keeps for each tag that isn't known yet.
TAG_ROOM = 96


class SeriesExists(ValueError):
    """A file that is to be created is there."""


def created(new: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata rows ``instance, schema, file_id, ..`` to add, and those that name a file which is there."""
    keys = ["instance", "schema", "file_id"]
    return new.join(known, keys, "left_anti"), new.join(known, keys, "left_semi")


def metadata(files: DataFrame, list_, xff: float, agg: str) -> DataFrame:
    """What a new file's header says, for ``instance, schema, file_id, tags``: rules, retention, and the room kept for free positions."""
    free = F.size(F.filter("tags", lambda t: t == ""))
    return files.select("instance", "schema", "file_id", "tags", F.lit(agg).alias("agg"), F.lit(float(xff)).alias("xff"), F.lit(max_retention(list_)).cast("bigint").alias("max_retention"), array_of(list_).alias("archives"), (free * TAG_ROOM).cast("int").alias("reserved_size"))


def create_series(files: DataFrame, known: DataFrame, list_, xff: float, agg: str) -> DataFrame:
    """The metadata table with new files; an error where one of them is there."""
    add, there = created(files, known)
    if taken := there.select("instance", "schema", "file_id").head(1):
        raise SeriesExists(f"file {tuple(taken[0])} is there")
    return known.unionByName(metadata(add, list_, xff, agg))


def add_tags(meta: DataFrame, tags: DataFrame) -> DataFrame:
    """``meta`` with tags ``instance, schema, file_id, pos, metric`` put in their places, one or more a file.

    ``in_place``: whether the header has the room; the rest of the room stays reserved. Else the file is written anew, without room.
    """
    keys = ["instance", "schema", "file_id"]
    by = tags.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", "metric"))).alias("_new"))  # a file's positions at most
    after = F.transform("tags", lambda t, i: F.coalesce(F.try_element_at(F.col("_new"), i), t))
    size = lambda tags_: F.aggregate(tags_, F.lit(0), lambda n, t: n + F.length(t))
    room = F.col("reserved_size") - (size(F.col("_after")) - size(F.col("tags")))
    put = meta.join(by, keys, "left").withColumn("_after", F.when(F.col("_new").isNull(), F.col("tags")).otherwise(after)).withColumn("_room", room)
    rest = [c for c in meta.columns if c not in ("tags", "reserved_size")]
    return put.select(*rest, F.col("_after").alias("tags"), F.greatest("_room", F.lit(0)).cast("int").alias("reserved_size"), (F.col("_room") >= 0).alias("in_place"))


def change_meta(meta: DataFrame, schema: str, xff: float, agg: str) -> DataFrame:
    """``meta`` with a schema's factor and aggregate overwritten; points stay."""
    of = F.col("schema") == schema
    return meta.withColumn("xff", F.when(of, F.lit(float(xff))).otherwise(F.col("xff"))).withColumn("agg", F.when(of, F.lit(agg)).otherwise(F.col("agg")))


def tag_position(tags: Column, metric: Column) -> Column:
    """The place of a metric among a file's tags, from 0; null where it isn't there."""
    return F.nullif(F.array_position(tags, metric), F.lit(0)) - 1


def pick_column(rows: DataFrame, files: DataFrame, metrics: DataFrame) -> DataFrame:
    """One metric's points ``metric, ts, value`` of packed rows ``instance, schema, file_id, ts, vals``: the place of its tag is looked up."""
    keys = ["instance", "schema", "file_id"]
    placed = files.join(metrics, keys).select(*keys, "metric", tag_position(F.col("tags"), F.col("metric")).alias("_at")).filter("_at is not null")
    return rows.join(placed, keys).select("metric", "ts", F.get("vals", F.col("_at").cast("int")).alias("value"))


def transpose(rows: Column) -> Column:
    """Rows of equal length become columns."""
    width = F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0))
    at = F.filter(F.sequence(F.lit(-1), width - 1), lambda i: i >= 0)
    return F.transform(at, lambda i: F.transform(rows, lambda r: F.get(r, i)))


def flushed(buffer: DataFrame, bounds: DataFrame, end: int, step: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flush write buffers up to ``end``: what goes out, what stays, and where each buffer starts afterwards.

    ``buffer``: file, pos, ts, value, seq, with arrivals in order of ``seq``; the last arrival of each position and slot counts.
    ``bounds``: file, start_ts, width (positions). What goes out is dense: ``file, slot_ts, vals`` for every slot from the start to ``end``,
    nulls where nothing came. A buffer with nothing later starts anew (null); others start at the slot after the last one that went.
    """
    slots = buffer.withColumn("slot_ts", slot_floor(F.col("ts"), step)).groupBy("file", "pos", "slot_ts").agg(F.max_by("value", "seq").alias("value"))
    stop = F.floor(F.lit(end) / step).cast("bigint") * step
    known = slots.join(bounds, "file").filter(F.col("slot_ts") >= F.col("start_ts"))
    every = bounds.filter(F.col("start_ts") < stop).select("file", "width", F.explode(F.sequence(F.col("start_ts"), stop - step, F.lit(step).cast("bigint"))).alias("slot_ts"))
    cells = known.filter(F.col("slot_ts") < stop).groupBy("file", "slot_ts").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("cells"))  # a file's positions at most
    vals = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.try_element_at(F.col("cells"), i))
    out = every.join(cells, ["file", "slot_ts"], "left").select("file", "slot_ts", vals.alias("vals"))
    stays = known.filter(F.col("slot_ts") >= stop).select("file", "pos", "slot_ts", "value")
    latest = known.groupBy("file").agg(F.max("slot_ts").alias("latest"))
    starts = bounds.join(latest, "file", "left").select("file", F.when(F.col("start_ts") >= stop, F.col("start_ts")).when(F.col("latest") >= stop, stop).alias("start_ts"))
    return out, stays, starts


def merged_file(levels: DataFrame, names: list[str], list_) -> DataFrame:
    """Series side by side for a packed file: ``archive, ts, vals`` of points ``archive, metric, ts, value, seq``, gaps filled with nulls.

    Each archive has the slots from its first point on, as many as it holds.
    """
    parts = None
    for i, a in enumerate(archives(list_)):
        rows = merge_vectors(levels.filter(F.col("archive") == i), names).select(F.lit("").alias("metric"), F.col("ts").alias("slot_ts"), F.col("vals").alias("value"))
        own = fill_gaps(rows, a.step, a.count).select(F.lit(i).alias("archive"), F.col("slot_ts").alias("ts"), F.coalesce("value", F.array_repeat(F.lit(None).cast("double"), len(names))).alias("vals"))
        parts = own if parts is None else parts.unionByName(own)
    return parts


def write_merged(levels: DataFrame, names: list[str], list_, path: str) -> None:
    """Write the merged file's rows, one folder an archive."""
    merged_file(levels, names, list_).write.mode("errorifexists").partitionBy("archive").parquet(path)
