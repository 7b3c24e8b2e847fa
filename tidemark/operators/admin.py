"""Maintenance operators: index, allocation, search, deletion, schema changes, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import data_path, fnv1a, metric_path, self_metric, slot_floor
from ..plans.archives import archives, array_of
from .timeline import align, cascade


def foreign(metric: Column, instance: Column, instances: int, self_prefix: str) -> Column:
    """Whether a metric belongs to another instance; self-metrics belong to each."""
    return ~F.startswith(metric, F.lit(self_prefix)) & (F.pmod(fnv1a(metric), F.lit(instances)) != instance)


def allocate(new: DataFrame, per_file: int, order: list[str]) -> DataFrame:
    """File and position for metrics of each (instance, schema) in order of arrival: files fill up one by one."""
    nth = F.row_number().over(Window.partitionBy("instance", "schema").orderBy(*order)) - 1
    return new.withColumn("nth", nth).withColumn("file_id", F.floor(F.col("nth") / per_file).cast("int")).withColumn("pos", (F.col("nth") % per_file).cast("int")).drop("nth")


def allocate_free(new: DataFrame, index: DataFrame, per_file: int, order: list[str]) -> DataFrame:
    """The same where positions are taken: the lowest free ones first, then new files."""
    keys = ["instance", "schema"]
    wanted = new.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    need = wanted.groupBy(*keys).agg(F.max("nth").alias("need"))
    used = index.groupBy(*keys).agg(F.count("*").alias("used"))
    room = need.join(used, keys, "left").select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("need") + F.coalesce("used", F.lit(0)) - 1)).alias("place"))
    taken = index.select(*keys, (F.col("file_id") * per_file + F.col("pos")).cast("bigint").alias("place"))
    free = room.join(taken, [*keys, "place"], "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("place")))
    return wanted.join(free, [*keys, "nth"]).withColumn("file_id", F.floor(F.col("place") / per_file).cast("int")).withColumn("pos", (F.col("place") % per_file).cast("int")).drop("nth", "place")


def files_of(index: DataFrame, per_file: int) -> DataFrame:
    """Files with their tags by position, empty where free."""
    by = F.map_from_entries(F.collect_list(F.struct("pos", "metric")))
    tags = F.transform(F.sequence(F.lit(0), F.lit(per_file - 1)), lambda i: F.coalesce(F.try_element_at(F.col("by"), i), F.lit("")))
    return index.groupBy("instance", "schema", "file_id").agg(by.alias("by")).select("instance", "schema", "file_id", tags.alias("tags"))


def rebuild_index(files: DataFrame) -> DataFrame:
    """The index of files' tags; free positions aren't listed."""
    return files.select("instance", "schema", "file_id", F.posexplode("tags").alias("pos", "metric")).filter("metric <> ''").select("metric", "instance", "schema", "file_id", "pos")


def links(index: DataFrame, link_root: str, data_root: str) -> DataFrame:
    """Each metric's link and the packed file it leads to."""
    link = metric_path(F.concat_ws("/", F.lit(link_root), F.col("instance").cast("string")), F.col("metric"))
    return index.select("metric", link.alias("link"), data_path(data_root, F.col("instance"), F.col("schema"), F.col("file_id")).alias("file"))


def empty_files(files: DataFrame) -> DataFrame:
    return files.filter(F.forall("tags", lambda t: t == "")).select("instance", "schema", "file_id")


def free_positions(files: DataFrame) -> DataFrame:
    return files.select("instance", "schema", "file_id", F.size(F.filter("tags", lambda t: t == "")).alias("free"))


def locate(points: DataFrame, index: DataFrame) -> DataFrame:
    """Points with the place of their metric; an equi join, which Spark broadcasts where the index is small."""
    return points.join(index, "metric")


def search(index: DataFrame, patterns: list[str]) -> DataFrame:
    """Metrics that begin with a match of any pattern: ``bucket, schema, fid, pos, metric``."""
    every = "|".join(f"(?:{p})" for p in patterns)
    return index.filter(F.col("metric").rlike(f"^(?:{every})")).select(F.col("instance").alias("bucket"), "schema", F.col("file_id").alias("fid"), "pos", "metric")


def files_without(index: DataFrame, blacklist: list[str]) -> DataFrame:
    """Files that hold no metric on the blacklist, without the last such file of each (instance, schema), which still fills."""
    keys = ["instance", "schema", "file_id"]
    bad = index.filter(F.col("metric").rlike("^(?:" + "|".join(f"(?:{p})" for p in blacklist) + ")")).select(*keys).distinct()
    good = index.select(*keys).distinct().join(bad, keys, "left_anti")
    return good.withColumn("last", F.max("file_id").over(Window.partitionBy("instance", "schema"))).filter("file_id < last").drop("last")


def delete(index: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index without listed metrics, and entries that name a place which holds another metric.

    ``gone``: metric, instance, schema, file_id, pos.
    """
    keys = ["instance", "schema", "file_id", "pos"]
    held = gone.select(*keys, F.col("metric").alias("asked")).join(index, keys, "left")
    mismatched = held.filter(~F.col("asked").eqNullSafe(F.col("metric"))).select(*keys, "asked", F.col("metric").alias("held"))
    return index.join(gone, [*keys, "metric"], "left_anti"), mismatched


def delete_report(gone: DataFrame) -> DataFrame:
    """Deleted metrics by file: ``instance, schema, file_id, metrics``, sorted."""
    return gone.groupBy("instance", "schema", "file_id").agg(F.sort_array(F.collect_list("metric")).alias("metrics"))


def zero_fill(metrics: DataFrame, blacklist: DataFrame, now: int) -> DataFrame:
    """Value 0 at ``now`` for each metric that isn't listed."""
    return metrics.select("metric").exceptAll(metrics.select("metric").join(blacklist, "metric", "left_semi")).distinct().select("metric", F.lit(now).cast("bigint").alias("ts"), F.lit(0.0).alias("value"))


def rebuild(levels: DataFrame, old, new, now: int, xff: float, agg: str) -> list[DataFrame]:
    """Levels of a changed schema from the old one's points ``archive, metric, slot_ts, value``; finer points win.

    Points go to the finest new archive that is at least as coarse as theirs and reaches them; each new level is
    what was cascaded from the finer one, where that is known, else what was written.
    """
    fits = F.filter(array_of(new), lambda a: (a["step"] * a["count"] >= F.lit(now) - F.col("slot_ts")) & (a["step"] >= F.element_at(F.array(*[F.lit(a.step) for a in archives(old)]), F.col("archive") + 1)))
    placed = levels.withColumn("to", F.try_element_at(fits, F.lit(1))["archive"]).filter(F.col("to").isNotNull())
    out: list[DataFrame] = []
    for i, a in enumerate(archives(new)):
        own = align(placed.filter(F.col("to") == i).select("metric", F.col("slot_ts").alias("ts"), "value", "archive"), a.step)
        own = own.groupBy("metric", "slot_ts").agg(F.min_by("value", F.struct("archive", "ts")).alias("value"), F.min("archive").alias("rank"))
        if out:
            made = cascade(out[-1], [archives(new)[i - 1], a], xff, agg)[1].withColumn("rank", F.lit(-1))
            own = own.unionByName(made)
        out.append(own.groupBy("metric", "slot_ts").agg(F.min_by("value", "rank").alias("value")))
    return out


def admit(creations: DataFrame, per_minute: int, order: list[str]) -> DataFrame:
    """Creations of each instance and minute up to a rate: the batch form of the token bucket."""
    minute = slot_floor(F.col("ts"), 60)
    nth = F.row_number().over(Window.partitionBy("instance", "minute").orderBy(*order))
    return creations.withColumn("minute", minute).withColumn("admitted", nth <= per_minute)


def self_metrics(events: DataFrame, prefix: str, host: str, every: int = 60) -> DataFrame:
    """The engine's own points: counted, greatest and mean figures of each instance and interval.

    ``events``: instance, ts, name, kind (``incr``, ``max`` or ``append``), value.
    """
    by = events.groupBy("instance", slot_floor(F.col("ts"), every).alias("ts"), "name")
    value = F.when(F.first("kind") == "incr", F.sum("value")).when(F.first("kind") == "max", F.max("value")).otherwise(F.avg("value"))
    return by.agg(value.alias("value")).select(self_metric(prefix, F.lit(host), F.col("instance"), F.col("name")).alias("metric"), "ts", "value")


#: The engine's own figures in an interval: name, and the statistic and way it comes from.
FIGURES = {"updateOperations": ("updateTimes", "count"), "avgUpdateTime": ("updateTimes", "avg"), "committedPoints": ("committedPoints", "sum"), "creates": ("creates", "sum"), "droppedCreates": ("droppedCreates", "sum"), "errors": ("errors", "sum"), "cacheQueries": ("cacheQueries", "sum"), "cacheOverflow": ("cacheOverflow", "sum"), "metricReceived": ("metricReceived", "sum"), "cpuUsage": ("cpuUsage", "max"), "memUsage": ("memUsage", "max")}
#: Figures that are left out of an interval without their statistic; all others are 0 then.
OPTIONAL = ("avgUpdateTime", "pointsPerUpdate", "cpuUsage", "memUsage")


def operator_metrics(stats: DataFrame, prefix: str, host: str, every: int = 60) -> DataFrame:
    """All of the engine's own points from raw statistics ``instance, ts, name, value``: ``metric, ts, value``, to be ingested like others.

    One point per figure, instance and interval with any statistic. Committed points without an update give no mean.
    """
    ways = {"count": F.count, "avg": F.avg, "sum": F.sum, "max": F.max}
    of = lambda stat: F.when(F.col("name") == stat, F.col("value"))
    by = stats.groupBy("instance", slot_floor(F.col("ts"), every).alias("ts")).agg(*[ways[way](of(stat)).cast("double").alias(figure) for figure, (stat, way) in FIGURES.items()])
    points = F.when((F.col("committedPoints") > 0) & (F.col("updateOperations") > 0), F.col("committedPoints") / F.col("updateOperations"))
    full = by.withColumn("pointsPerUpdate", points).fillna(0.0, [c for c in FIGURES if c not in OPTIONAL])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).alias("value")) for c in [*FIGURES, "pointsPerUpdate"]]))
    out = full.select("instance", "ts", each.alias("f")).filter("f.value is not null")
    return out.select(self_metric(prefix, F.lit(host), F.col("instance"), F.col("f.figure")).alias("metric"), "ts", F.col("f.value").alias("value"))
