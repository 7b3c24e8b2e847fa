"""Text sources: the line protocol, batches of points, indexes and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``metric value timestamp`` by white space; anything else is dropped, and NaN is no value.

    A time stamp must be whole. Works on static and streaming frames alike.
    """
    parts = F.split(F.trim(F.col(column)), r"\s+")
    ts = F.when(parts[2].rlike(r"^[+-]?\d+$"), parts[2].try_cast("bigint"))
    parsed = lines.filter(F.size(parts) == 3).select(parts[0].alias("metric"), ts.alias("ts"), parts[1].try_cast("double").alias("value"))
    return parsed.filter("ts is not null and value is not null and not isnan(value)")


def malformed_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    parts = F.split(F.trim(F.col(column)), r"\s+")
    good = (F.size(parts) == 3) & parts[2].rlike(r"^[+-]?\d+$") & parts[1].try_cast("double").isNotNull()
    return lines.filter(~F.coalesce(good, F.lit(False)))


def explode_batches(batches: DataFrame, column: str = "points") -> DataFrame:
    """Points of ``array<struct<metric, ts, value>>``; a fractional time stamp is truncated, a bad point skipped."""
    p = F.col("p")
    return batches.select(F.explode(column).alias("p")).select(p["metric"].alias("metric"), p["ts"].try_cast("double").cast("bigint").alias("ts"), p["value"].try_cast("double").alias("value")).filter("metric is not null and ts is not null and value is not null and not isnan(value)")


def json_batches(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Files of JSON lines ``{"points": [{"metric", "ts", "value"}]}``."""
    reader = spark.readStream if streaming else spark.read
    return explode_batches(reader.schema("points array<struct<metric:string,ts:string,value:string>>").json(path))


def read_index(spark: SparkSession, path: str, allowed: int = 1) -> DataFrame:
    """An index of ``metric schema file_id pos`` lines; more than ``allowed`` bad ones are an error."""
    parts = F.split(F.col("value"), " ")
    lines = spark.read.text(path).filter("value <> ''")
    row = lines.withColumn("ok", (F.size(parts) == 4) & F.coalesce(F.try_element_at(parts, F.lit(3)).rlike(r"^\d+$") & F.try_element_at(parts, F.lit(4)).rlike(r"^\d+$"), F.lit(False)))
    bad = row.filter("not ok").limit(allowed + 1).count()
    if bad > allowed:
        raise ValueError(f"{path} has more than {allowed} malformed lines")
    return row.filter("ok").select(parts[0].alias("metric"), parts[1].alias("schema"), parts[2].cast("int").alias("file_id"), parts[3].cast("int").alias("pos"))


def write_index(index: DataFrame, path: str, mode: str = "append") -> None:
    index.select(F.concat_ws(" ", "metric", "schema", "file_id", "pos").alias("value")).write.mode(mode).text(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list file, trimmed; blank ones and ``#`` comments don't count."""
    line = F.trim(F.col("value"))
    return spark.read.text(path).filter((line != "") & ~F.startswith(line, F.lit("#"))).select(line.alias("line"))


def data_files(spark: SparkSession, root: str, suffix: str = ".hs") -> DataFrame:
    """Packed files of ``<root>/<instance>/<schema>/<id><suffix>``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    return found.select("path", place(F.col("path"), suffix).alias("place")).select("path", "place.*")


def place(path: Column, suffix: str = ".hs") -> Column:
    got = lambda i: F.regexp_extract(path, rf"/([^/]+)/([^/]+)/(\d+){suffix.replace('.', '[.]')}$", i)
    return F.struct(got(1).alias("instance"), got(2).alias("schema"), got(3).try_cast("int").alias("file_id"))


def generate(spark: SparkSession, metrics: list[str], start: int, step: int, count: int) -> DataFrame:
    """A load of points: ``count`` per metric, the i-th of the j-th metric being ``10 j + i``."""
    names = F.array(*map(F.lit, metrics))
    rows = spark.range(count).select((F.lit(start) + F.col("id") * step).alias("ts"), F.col("id").alias("seq"), F.posexplode(names).alias("j", "metric"))
    return rows.select("metric", "ts", (F.col("j") * 10 + F.col("seq")).cast("double").alias("value"), "seq")


def rate_points(spark: SparkSession, metrics: list[str], per_second: int) -> DataFrame:
    """The same as a stream."""
    names = F.array(*map(F.lit, metrics))
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rate.select(F.element_at(names, (F.col("value") % len(metrics) + 1).cast("int")).alias("metric"), F.unix_seconds("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))


def write_tsv(series: DataFrame, path: str, mode: str = "errorifexists") -> None:
    series.select("ts", "value").write.mode(mode).option("sep", "\t").option("nullValue", "").csv(path)
