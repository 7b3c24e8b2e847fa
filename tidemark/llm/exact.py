"""Exact deduplication by two passes of a Bloom filter."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, Stage, join_by_group, sheltered, tidy

#: Bits of a filter for a row, and the most bits of one filter: 32 MB. More digests than suit one are split by their first bits.
BITS_PER_ROW = 16
MAX_BITS = 1 << 28
BLOCK_BITS = 1 << 15
PROBES = 4
#: Copies of one row that are listed at once.
SPREAD = 10_000


def normalised(text: Column) -> Column:
    """Every run of blanks becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def _positions(digests: pa.Array, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each digest and its probes in there, as bit numbers of the whole filter."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), dtype=">u8").reshape(-1, 4)
    block = (raw[:, 0] % np.uint64(blocks)).astype(np.int64)
    bits = np.stack([(raw[:, 1] >> np.uint64(15 * i)).astype(np.int64) % BLOCK_BITS for i in range(PROBES)], axis=1)
    return block, block[:, None] * BLOCK_BITS + bits


def _set(filter_: np.ndarray, bits: np.ndarray) -> None:
    np.bitwise_or.at(filter_, bits >> 3, np.left_shift(1, bits & 7).astype(np.uint8))


def _get(filter_: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (filter_[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool).all(axis=1)


def _build(blocks: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(blocks * BLOCK_BITS // 8, dtype=np.uint8)
        again = np.zeros_like(seen)
        touched = np.zeros(blocks, dtype=bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            block, bits = _positions(batch.column(0), blocks)
            rows, first, counts = np.unique(bits, axis=0, return_index=True, return_counts=True)
            repeated = rows[(counts > 1) | _get(seen, rows)]
            _set(again, repeated.ravel())
            _set(seen, rows.ravel())
            touched[block] = True
        ids = np.flatnonzero(touched)
        size = BLOCK_BITS // 8
        for start in range(0, len(ids), 1024):
            part = ids[start : start + 1024]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(part, pa.int32()),
                "seen": [zlib.compress(seen[i * size : (i + 1) * size].tobytes(), 1) for i in part],
                "again": [zlib.compress(again[i * size : (i + 1) * size].tobytes(), 1) for i in part],
            })

    return build


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; a bit is kept where two tasks have set it, or one twice."""
    now, seen, again = None, None, None

    def out() -> Iterator[pa.RecordBatch]:
        if now is not None and again.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()), "again": [zlib.compress(again.tobytes(), 1)]})

    for batch in batches:
        for block, s, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s, a = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in (s, a))
            if block != now:
                yield from out()
                now, seen, again = block, s.copy(), a.copy()
            else:
                again |= a | (seen & s)
                seen |= s
    yield from out()


def repeat_filter(digests: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """First pass: the bits of all digests that occur more than once, and some others.

    Each task fills a filter of its own; the tasks' blocks, compressed, meet by block number. The filter grows with ``rows``.
    """
    bits = BLOCK_BITS
    while bits < rows * BITS_PER_ROW:
        bits *= 2
    blocks = bits // BLOCK_BITS
    parts = digests.mapInArrow(_build(blocks), "block int, seen binary, again binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block int, again binary")
    again = np.zeros(bits // 8, dtype=np.uint8)
    size = BLOCK_BITS // 8
    for block, packed in merged.collect():  # one row per block of one filter
        again[block * size : (block + 1) * size] = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    return again, blocks


def _split(filter_, blocks: int, repeated: bool):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hit = _get(filter_.value, _positions(batch.column(1), blocks)[1])
                yield batch.filter(pa.array(hit if repeated else ~hit))

    return split


def _grouped(digests: DataFrame, rows: int) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, sha`` of the digests of one filter."""
    spark = digests.sparkSession
    again, blocks = repeat_filter(digests.select("sha"), rows)
    filter_ = spark.sparkContext.broadcast(again)
    schema = "doc_id long, sha binary"
    maybe = Stage(digests.mapInArrow(_split(filter_, blocks, True), schema).groupBy("sha", "doc_id").agg(F.count("*").alias("copies")), "repeated")
    groups = maybe.df.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    met = join_by_group(maybe.df, groups, "sha", "group_size", rows)
    spread = met.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {SPREAD}"))))  # copies of one row, in parts
    each = spread.withColumn("nth", F.explode(F.expr(f"sequence(part * {SPREAD}, least(copies, (part + 1) * {SPREAD}) - 1)")))
    found = each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 0)).alias("kept"), "sha")
    alone = digests.mapInArrow(_split(filter_, blocks, False), schema).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return found.unionByName(alone)


@tidy
def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MAX_BITS) -> DataFrame:
    """Group documents whose texts are equal after folding runs of blanks into one space.

    One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. Texts are read
    once, for their digests; only rows whose digest the filter finds possibly repeated shuffle. A filter has ``most_bits``
    bits at most; of more rows than suit that, digests are written by their first bits, in as many parts as it takes, each
    with a filter of its own, so that the share of rows that shuffle doesn't grow with the table.

    Null texts count as empty, and empty texts equal each other. Of equal texts the row with the
    smallest id stays; of repeated rows with that same id, one does; a null id stays only if
    all ids of its group are null. Long texts are digested whole. An empty table gives no rows.
    Other columns of the input, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    digests = Stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha")), "digests")
    rows, parts = digests.count(), 1
    while rows * BITS_PER_ROW > most_bits * parts:
        parts *= 2
    if parts == 1:
        return _named(_grouped(digests.df, rows))
    path = f"{digests.path}-parts"
    done, _ = Stage.at(spark, f"{path}-done"), Stage.at(spark, path)
    part = F.pmod(F.conv(F.hex(F.substring("sha", 25, 4)), 16, 10).cast("long"), F.lit(parts)).cast("int")
    digests.df.withColumn("part", part).write.partitionBy("part").parquet(path)
    digests.drop()
    for i in range(parts):
        own = spark.read.parquet(path).filter(F.col("part") == i).drop("part")
        _grouped(own, max(1, own.count())).write.mode("append").parquet(done.path)
    return _named(done.df)


def _named(found: DataFrame) -> DataFrame:
    return found.withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, with all its columns, without copies of another row's text, whatever their ids: of rows that repeat id and text one stays."""
    rows = sheltered(docs, id_col, text_col)
    keyed = rows.withColumn("_sha", F.lower(F.sha2(normalised(F.col(text_col)), 256)))
    kept = exact_groups(rows, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    met = keyed.join(kept, (keyed["_sha"] == kept["_sha"]) & keyed[id_col].cast("long").eqNullSafe(kept["_keep"]), "left_semi")
    return met.dropDuplicates(["_sha"]).select(rows.columns).toDF(*docs.columns)
