"""Import of packed binary files: many metrics to a file, or one."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.aggregates import aggregate_id, aggregate_name

# The layouts, big-endian. A file of many metrics has tab-joined tags, the last being reserved
# room, and rows of a time stamp and one double per tag; its null is the given number. A file of one metric
# has no tags, and its aggregates count from 1.
META_MANY, META_ONE, ARCHIVE = struct.Struct(">2Lf3L"), struct.Struct(">2LfL"), struct.Struct(">3L")
NULL = -4294967296.0

POINTS = "path string, metric string, agg string, xff double, archive int, step bigint, count bigint, slot_ts bigint, value double"
HEADERS = "path string, agg string, max_retention bigint, xff double, tags array<string>, reserved_size int, point_size int, archives array<struct<offset:bigint,step:bigint,count:bigint,size:bigint,retention:bigint>>"


def pack_header(tags: list[str], list_, xff: float, agg: str, reserved: int = 0) -> bytes:
    """The header of a file of many metrics."""
    text = "\t".join([*tags, "N" * reserved]).encode()
    point = 4 + 8 * len(tags)
    out = [META_MANY.pack(aggregate_id(agg), list_[-1][0] * list_[-1][1], xff, len(list_), len(text), point), text]
    offset = META_MANY.size + len(text) + ARCHIVE.size * len(list_)
    for step, count in list_:
        out.append(ARCHIVE.pack(offset, step, count))
        offset += point * count
    return b"".join(out)


def read_header(data: bytes, many: bool = True) -> dict:
    if many:
        agg, keep, xff, n, tag_size, point = META_MANY.unpack_from(data)
        *tags, rest = data[META_MANY.size : META_MANY.size + tag_size].decode().split("\t")
        at = META_MANY.size + tag_size
    else:
        agg, keep, xff, n = META_ONE.unpack_from(data)
        agg, tags, rest, point, at = agg - 1, [""], "", 12, META_ONE.size
    found = []
    for i in range(n):
        offset, step, count = ARCHIVE.unpack_from(data, at + i * ARCHIVE.size)
        found.append({"offset": offset, "step": step, "count": count, "size": point * count, "retention": step * count})
    return {"agg": aggregate_name(agg), "max_retention": keep, "xff": xff, "tags": tags, "reserved_size": len(rest), "point_size": point, "archives": found}


def _headers(many: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pylist([{"path": path, **read_header(data, many)}], schema=_header_schema())

    return read


def _header_schema() -> pa.Schema:
    item = pa.struct([(n, pa.int64()) for n in ("offset", "step", "count", "size", "retention")])
    return pa.schema([("path", pa.string()), ("agg", pa.string()), ("max_retention", pa.int64()), ("xff", pa.float64()), ("tags", pa.list_(pa.string())), ("reserved_size", pa.int32()), ("point_size", pa.int32()), ("archives", pa.list_(item))])


def _points(many: bool, wanted: frozenset[str] | None = None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = read_header(data, many)
                kind = np.dtype([("ts", ">u4"), ("vals", ">f8", (len(h["tags"]),))])
                for i, a in enumerate(h["archives"]):
                    rows = np.frombuffer(data, dtype=kind, count=a["count"], offset=a["offset"])
                    rows = rows[rows["ts"] != 0]
                    for j, tag in enumerate(h["tags"]):
                        if many and not tag or wanted is not None and tag not in wanted:
                            continue
                        n, values = len(rows), rows["vals"][:, j].astype(np.float64)
                        yield pa.RecordBatch.from_pydict({
                            "path": [path] * n, "metric": [tag] * n, "agg": [h["agg"]] * n, "xff": [h["xff"]] * n, "archive": pa.array([i] * n, pa.int32()), "step": pa.array([a["step"]] * n, pa.int64()),
                            "count": pa.array([a["count"]] * n, pa.int64()), "slot_ts": pa.array(rows["ts"].astype(np.int64)), "value": pa.array(values, mask=values == NULL),
                        })

    return read


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content")


def headers(spark: SparkSession, path: str, many: bool = True, glob: str = "*") -> DataFrame:
    return _files(spark, path, glob).mapInArrow(_headers(many), HEADERS)


def points(spark: SparkSession, path: str, many: bool = True, glob: str = "*", metrics: list[str] | None = None) -> DataFrame:
    """All written slots of all files under ``path``, by archive; the null number becomes null. Of ``metrics``, where given, only their columns are read.

    Whole files are rows of an Arrow batch: ``spark.sql.execution.arrow.maxRecordsPerBatch`` bounds how many a worker holds.
    """
    return _files(spark, path, glob).mapInArrow(_points(many, None if metrics is None else frozenset(metrics)), POINTS)


def recent(stored: DataFrame, now: int) -> DataFrame:
    """Slots younger than their archive's retention."""
    return stored.filter(f"slot_ts > {int(now)} - step * count")


def pack_points(rows: list[tuple[int, list[float | None]]]) -> bytes:
    return b"".join(struct.pack(f">L{len(v)}d", ts, *[NULL if x is None else x for x in v]) for ts, v in rows)
