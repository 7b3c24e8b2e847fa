"""The Parquet store: appended points by schema, archive and day, and their settled levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import slot_floor
from ..operators.timeline import complete, dense, downsample
from ..plans.archives import array_of, plan_fetch, units, validated
from ..plans.rules import FALLBACK, Rule, rule_of

DAY = 86400
POINTS = "metric string, slot_ts bigint, value double, seq bigint, schema string, archive int, day int"
GONE = "metric string, seq bigint"
SETTLED = "schema string, archive int, instance int, file_id int, upto bigint"
#: Tasks that the points of one schema, archive and day are dealt over, by metric.
SPREAD = 16
#: Metrics up to which a fetch's list is pushed down to the files.
PUSHED = 1000


class Store:
    """Appended writes with latest-wins reads; ``seq`` numbers writes, so that repeating one changes nothing.

    Files are partitioned by schema, archive and day, dealt by metric and sorted by metric and slot: a fetch of a few metrics
    reads the row groups that may hold them. ``index`` (metric, instance, schema, file_id) says which metrics share a file, whose
    newest slot completes units; without it all metrics of a schema do.
    """

    def __init__(self, spark: SparkSession, path: str, rules: list[Rule], index: DataFrame | None = None, spread: int = SPREAD):
        self.spark, self.path, self.index, self.spread = spark, path, index, spread
        self.ordered, self.rules = rules, {FALLBACK.name: FALLBACK} | {r.name: r for r in rules}
        for r in self.rules.values():
            validated(r.archives, r.xff)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _points(self, schema: str, archive: int) -> DataFrame:
        """What has been written to an archive and not deleted since."""
        own = self._read("points", POINTS).filter((F.col("schema") == schema) & (F.col("archive") == archive))
        gone = self._read("gone", GONE).groupBy("metric").agg(F.max("seq").alias("gone"))
        return own.join(gone, "metric", "left").filter("gone is null or seq > gone").drop("gone")

    def _save(self, rows: DataFrame) -> None:
        out = rows.select("metric", "slot_ts", "value", F.col("seq").cast("bigint").alias("seq"), "schema", F.col("archive").cast("int").alias("archive"), F.floor(F.col("slot_ts") / DAY).cast("int").alias("day"))
        placed = out.repartition("schema", "archive", "day", F.pmod(F.xxhash64("metric"), F.lit(self.spread))).sortWithinPartitions("schema", "archive", "day", "metric", "slot_ts")
        placed.write.mode("append").partitionBy("schema", "archive", "day").parquet(f"{self.path}/points")

    def _lists(self) -> Column:
        """The archive list of a row's schema."""
        return F.element_at(F.create_map(*[x for r in self.rules.values() for x in (F.lit(r.name), array_of(r.archives))]), F.col("schema"))

    def append(self, points: DataFrame, seq: int, now: int | None = None) -> None:
        """Write ``metric, ts, value, seq``: one row per slot, the last arrival by the points' own ``seq``.

        With ``now``, a point goes to the finest archive that reaches it, and is dropped where none does; else all go to the finest.
        """
        tagged = points.withColumn("schema", rule_of(F.col("metric"), self.ordered)).withColumn("_list", self._lists())
        age = F.lit(now) - F.col("ts") if now is not None else F.lit(0)
        fits = F.filter("_list", lambda a: a["step"] * a["count"] >= age)
        placed = tagged.withColumn("_to", F.get(fits, F.lit(0))).filter(F.col("_to").isNotNull())
        slot = (F.floor(F.col("ts") / F.col("_to.step")) * F.col("_to.step")).cast("bigint")
        last = placed.groupBy("schema", F.col("_to.archive").alias("archive"), "metric", slot.alias("slot_ts")).agg(F.max_by("value", "seq").alias("value"))
        self._save(last.withColumn("seq", F.lit(seq)))

    def level(self, schema: str, archive: int, since: int | None = None) -> DataFrame:
        """``metric, slot_ts, value`` of an archive: the last write of each slot, from ``since`` on."""
        rows = self._points(schema, archive)
        if since is not None:
            rows = rows.filter((F.col("day") >= since // DAY) & (F.col("slot_ts") >= since))
        return rows.groupBy("metric", "slot_ts").agg(F.max_by("value", "seq").alias("value"))

    def held(self, schema: str, archive: int, now: int) -> DataFrame:
        """What an archive holds at ``now``: slots within its retention."""
        retention = self.rules[schema].archives[archive].retention
        return self.level(schema, archive, now - retention).filter(F.col("slot_ts") > now - retention)

    def _files(self, rows: DataFrame, schema: str) -> DataFrame:
        """Rows with the file of their metric."""
        if self.index is None:
            return rows.withColumns({"instance": F.lit(0), "file_id": F.lit(0)})
        return rows.join(self.index.filter(F.col("schema") == schema).select("metric", "instance", "file_id"), "metric")

    def settle(self, schema: str, seq: int, since: int | None = None) -> None:
        """Derive every coarser level from complete units of the next finer one.

        With ``since``, the least time stamp of what is new, only what a file hasn't settled yet, and what is new, is read. What was
        written to a coarser level directly stays where no finer slot says otherwise.
        """
        r, keys = self.rules[schema], ["instance", "file_id"]
        for i, (unit, coarse) in enumerate(zip(units(r.archives, r.xff), r.archives[1:], strict=True)):
            done = self._read("settled", SETTLED).filter((F.col("schema") == schema) & (F.col("archive") == i)).groupBy(*keys).agg(F.max("upto").alias("upto"))
            begin = None
            if since is not None:
                first = done.agg(F.min("upto")).first()[0]  # one row
                begin = None if first is None else min(since, first) // coarse.step * coarse.step
            fine = self._files(self.level(schema, i, begin), schema)
            if begin is not None:
                known = done.withColumn("upto", F.least("upto", F.lit(since)))
                fine = fine.join(known, keys, "left").filter(F.col("upto").isNull() | (F.col("slot_ts") >= F.floor(F.col("upto") / coarse.step) * coarse.step)).drop("upto")
            made = downsample(complete(fine, unit, tuple(keys)), coarse.step, r.agg, (*keys, "metric")).select("metric", "slot_ts", "value")
            self._save(made.withColumns({"schema": F.lit(schema), "archive": F.lit(i + 1), "seq": F.lit(seq)}))
            newest = fine.groupBy(*keys).agg(slot_floor(F.max("slot_ts"), unit).alias("upto"))
            newest.select(F.lit(schema).alias("schema"), F.lit(i).alias("archive"), *keys, "upto").write.mode("append").parquet(f"{self.path}/settled")

    def touched(self, points: DataFrame) -> dict[str, int]:
        """The schemas of some points, with the least time stamp of each: as many rows as rules at most."""
        rows = points.select(rule_of(F.col("metric"), self.ordered).alias("schema"), "ts").groupBy("schema").agg(F.min("ts").alias("since")).collect()
        return {r.schema: r.since for r in rows}

    def delete(self, metrics: DataFrame, seq: int) -> None:
        """Hide all that was written of some metrics up to write ``seq``; later writes count again."""
        metrics.select("metric", F.lit(seq).cast("bigint").alias("seq")).write.mode("append").parquet(f"{self.path}/gone")

    def expire(self, now: int) -> int:
        """Delete the days that no archive holds any more; the number of folders that went."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/points")
        files, gone = root.getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        for name, rule in self.rules.items():
            for i, a in enumerate(rule.archives):
                for found in files.globStatus(hadoop.Path(root, f"schema={name}/archive={i}/day=*")) or []:
                    if (int(found.getPath().getName().partition("=")[2]) + 1) * DAY <= now - a.retention:
                        gone += files.delete(found.getPath(), True)
        return gone

    def fetch(self, schema: str, metrics: DataFrame | list[str], start: int, until: int | None, now: int) -> DataFrame | None:
        """A dense series of each metric from the finest archive that reaches back to ``start``.

        Only days of the range are read, and only rows of the metrics are aggregated; a list of up to ``PUSHED`` names is pushed down.
        """
        range_ = plan_fetch(self.rules[schema].archives, start, until, now)
        if range_ is None:
            return None
        rows = self._points(schema, range_.archive).filter((F.col("day") >= range_.start // DAY) & (F.col("day") <= range_.until // DAY) & (F.col("slot_ts") >= range_.start) & (F.col("slot_ts") < range_.until))
        if isinstance(metrics, list):
            rows = rows.filter(F.col("metric").isin(metrics)) if len(metrics) <= PUSHED else rows
            metrics = self.spark.createDataFrame([(m,) for m in metrics], "metric string")
        own = rows.join(metrics.select("metric").distinct(), "metric", "left_semi")
        return dense(own.groupBy("metric", "slot_ts").agg(F.max_by("value", "seq").alias("value")), metrics, range_)
