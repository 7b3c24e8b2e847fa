"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: A word: a run of anything but space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

#: Rows in an Arrow batch that carries texts, which bounds a worker's memory when texts are long; and in one of numbers.
TEXT_BATCH = 256
ROW_BATCH = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: With this, a finished write's shuffle files go at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the actions of a block; then it is as before."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def batches_of(spark: SparkSession, rows: int | None) -> AbstractContextManager:
    """The size of Arrow batches in a block."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)) if rows else nullcontext()


class Stage:
    """A table written to the shared folder: cuts lineage and outlives lost executors."""

    def __init__(self, df: DataFrame, tag: str, batch: int | None = None):
        """``batch``: rows of an Arrow batch while the table is made."""
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
        with setting(self.spark, CLEANUP, "true"), batches_of(self.spark, batch):
            df.write.parquet(self.path)
        if _made:
            _made[-1].append(self)

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Stage:
        """A table that has been written to a path of the shared folder by other means."""
        made = cls.__new__(cls)
        made.spark, made.path = spark, path
        if _made:
            _made[-1].append(made)
        return made

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def count(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        """Delete the files; only for tables that no returned frame reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables that the operators under way have written, by operator.
_made: list[list[Stage]] = []


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with its result written, so that nothing reads its other tables any more, and these deleted."""

    @wraps(operator)
    def run(*args, **named) -> DataFrame:
        _made.append([])
        try:
            kept = Stage(operator(*args, **named), operator.__name__.strip("_"))
        finally:
            made = _made.pop()
        for stage in made:
            if stage is not kept:
                stage.drop()
        if _made:
            _made[-1].append(kept)
        return kept.df

    return run


def sheltered(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` with all columns but ``own`` renamed by place, so that no helper column clashes; ``toDF`` gives them back."""
    return docs.toDF(*[c if c in own else f"_in{i}" for i, c in enumerate(docs.columns)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though a lambda in it reads the value for each of its elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def null_key(c: Column) -> Column:
    """A non-null string that differs for null and every value, so that null joins null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def hot_rows(total: int) -> int:
    """Rows of a key above which it is hot: 100,000 at most up to 10^10 rows; never are more than 100,000 keys hot."""
    return max(min(max(total // 1000, 1000), 100_000), total // 100_000)


def join_by_group(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one short row per ``key`` and its row count in ``rows``.

    Hot groups, 100,000 of them at most, are broadcast, so that a hot key's rows stay where they are; the
    rest meet in a shuffle.
    """
    on = [key] if isinstance(key, str) else key
    most = hot_rows(total)
    hot = groups.filter(F.col(size) > most)
    cold = groups.filter(F.col(size) <= most)
    if total <= most:
        return rows.join(groups, on)
    names = [*rows.columns, *[c for c in groups.columns if c not in on]]
    hot_part = rows.join(F.broadcast(hot), on).select(names)
    cold_part = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on).select(names)
    return hot_part.unionByName(cold_part)


def salted_join(rows: DataFrame, wide: DataFrame, key: str, counted: DataFrame, by: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``wide``, which has one row per ``key`` of any width.

    ``counted``, a written table, has the keys as often as ``rows``. A hot key's rows are dealt over several places by the hash
    of their columns ``by``, and its wide row is repeated at each; only hot keys and their numbers of places are broadcast.
    """
    total = counted.count()
    most = hot_rows(total)
    if total <= most:
        return rows.join(wide, key)
    places = counted.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("_places"))
    dealt = rows.join(F.broadcast(places.filter("_places > 1")), key, "left").withColumn("_place", F.pmod(F.xxhash64(*by), F.coalesce("_places", F.lit(1))).cast("int")).drop("_places")
    repeated = places.join(wide, key).withColumn("_place", F.explode(F.sequence(F.lit(0), F.col("_places") - 1))).drop("_places")
    return dealt.join(repeated, [key, "_place"]).drop("_place")


#: Parts that a task's sums are cut into.
PARTS = 16


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            done[part] = done.get(part, 0) + np.frombuffer(sums)
    yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int32()), pa.array([x.tobytes() for x in done.values()], pa.binary())], ["part", "sums"])


def summed(rows: DataFrame, measure: Callable[..., np.ndarray], *given) -> np.ndarray | None:
    """The sum over all batches of ``rows`` of ``measure(batch, *given)``, a flat array of one length; None without rows."""
    shared = rows.sparkSession.sparkContext.broadcast(given)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch in batches:
            if batch.num_rows:
                got = measure(batch, *shared.value)
                done = got if done is None else done + got
        if done is not None:
            cut = np.array_split(done, PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], ["part", "sums"])

    parts = rows.mapInArrow(partial, "part int, sums binary").repartition(PARTS, "part").mapInArrow(_added, "part int, sums binary").collect()  # PARTS rows
    shared.unpersist()
    return np.concatenate([np.frombuffer(r.sums) for r in sorted(parts)]) if parts else None
