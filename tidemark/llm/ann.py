"""Approximate nearest neighbours by largest inner product: a graph per shard, shards' results merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, join_by_group, tidy
from .hnsw import Graph

#: Distinct vectors of a shard: 1/256 of all, but from so many to so many; queries of a block; width of a search.
SHARD_ROWS, MOST_ROWS = 8192, 65536
QUERY_ROWS = 1024
WIDTH = 128


def _stack(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors in one more dimension, in which nearness to a lifted query goes by inner product."""
    scaled = x / longest
    rest = np.sqrt(np.maximum(1 - np.einsum("nd,nd->n", scaled, scaled), 0))
    return np.column_stack([scaled, rest]).astype(np.float32)


def _build(longest: dict[int, float], kind: str):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; one row a shard comes out."""
        now, parts = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids)
            ids, x = ids[order], x[order]
            spread = np.random.default_rng(0).permutation(len(ids))
            ids, x = ids[spread], x[spread]
            graph = Graph(_lifted(x.astype(np.float64), longest[x.shape[1]]))
            yield pa.RecordBatch.from_pydict({
                "shard": [now], "dim": pa.array([x.shape[1]], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "vectors": [x.astype(kind).tobytes()],
                "links": pa.array([[level.astype("<i4").tobytes() for level in graph.links]], pa.list_(pa.binary())), "entry": pa.array([graph.entry], pa.int32()),
            })

        for batch in batches:
            shards = np.array(batch.column(0).to_pylist(), dtype=object)
            for shard in dict.fromkeys(shards):
                of = pa.array(shards == shard)
                part = batch.filter(of)
                if shard != now:
                    yield from out()
                    now, parts = shard, []
                parts.append((np.asarray(part.column(1)), _stack(part.column(2))))
        yield from out()

    return build


INDEX = "shard string, dim int, ids binary, vectors binary, links array<binary>, entry int"


def _blocks(kind: str):
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries packed by dimension, ``QUERY_ROWS`` to a row."""
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def pack(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "query_ids": [np.array([r[0] for r in rows], dtype="<i8").tobytes()], "queries": [np.stack([r[1] for r in rows]).astype(kind).tobytes()]})

        for batch in batches:
            for vid, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = vector.values.to_numpy(zero_copy_only=False)
                own = held.setdefault(len(v), [])
                own.append((vid, v))
                if len(own) >= QUERY_ROWS:
                    yield pack(len(v))
        for dim in list(held):
            yield pack(dim)

    return block


def _search(k: int, width: int, longest: dict[int, float], kind: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, dim = np.frombuffer(row["ids"], dtype="<i8"), row["dim"]
                x = np.frombuffer(row["vectors"], dtype=kind).reshape(-1, dim)
                links = [np.frombuffer(level, dtype="<i4").reshape(len(ids), -1) for level in row["links"]]
                graph = Graph(_lifted(x.astype(np.float64), longest[dim]), links=links, entry=row["entry"])
                q = np.frombuffer(row["queries"], dtype=kind).reshape(-1, dim).astype(np.float64)
                names = np.frombuffer(row["query_ids"], dtype="<i8")
                unit = q / np.sqrt(np.einsum("nd,nd->n", q, q))[:, None]
                found = graph.search(np.column_stack([unit, np.zeros(len(q))]), min(max(width, k), len(ids)))
                for i, (name, vector) in enumerate(zip(names, q, strict=True)):
                    at = found[i][found[i] >= 0]
                    scores = x[at].astype(np.float64) @ vector
                    best = np.lexsort((ids[at], -scores))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), name)), pa.array(ids[at][best]), pa.array(scores[best])], ["query", "vid", "score"])

    return search


@tidy
def nearest(vectors: DataFrame, k: int = 20, every: int = 20, width: int = WIDTH, shard_rows: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``, the ``k`` nearest other rows found: ``query_id, rank, vec_id, score``.

    Nearness is the inner product in double precision, ties go to the smaller id. Equal vectors are one point with
    its ``k + 1`` smallest ids, which are all that can count. Vectors of doubles are kept and scored as such. Points fall by hash into
    shards, which grow with the table up to a bound;
    each gets a graph, written with its flat neighbour arrays to the shared folder. Blocks of the distinct
    queries are searched in every shard, and the shards' best are merged. Every row is indexed.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part; nor do rows with a null
    id. Vectors of different lengths aren't compared. Repeated ids are listed once each time they occur, but never
    as neighbours of themselves. With fewer rows, all other rows are returned. Other columns aren't read.
    """
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    v = F.col("vector")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{'double' if kind == '<f8' else 'float'}>").alias("vector")).filter(F.col("id").isNotNull() & v.isNotNull()).filter(fine)
    named = Stage(rows, "vectors")
    total = named.count()
    shard_rows = shard_rows or min(max(SHARD_ROWS, total // 256), MOST_ROWS)
    salt = F.pmod(F.xxhash64("id"), F.lit(total // shard_rows + 1))
    least = named.df.groupBy("vector", salt.alias("salt")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"), F.count("*").alias("n"), F.max(F.col("id") % every == 0).alias("asks"))
    points = least.groupBy("vector").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.sum("n").alias("n"), F.max("asks").alias("asks"))
    points = Stage(points.withColumn("vid", F.col("ids")[0]).withColumn("dim", F.size("vector")), "points")
    dims = points.df.groupBy("dim").agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))).alias("longest")).collect()  # one row a length
    longest = {r.dim: float(r.longest) for r in dims}
    shards = {r.dim: -(-r.n // shard_rows) for r in dims}
    count = F.element_at(F.create_map(*[F.lit(x) for pair in (shards or {0: 1}).items() for x in pair]), F.col("dim"))
    sharded = points.df.withColumn("shard", F.concat_ws("-", "dim", F.pmod(F.xxhash64("vector", F.lit(1)), count))).select("shard", "vid", "vector")
    index = Stage(sharded.repartition(max(1, sum(shards.values())), "shard").sortWithinPartitions("shard").mapInArrow(_build(longest, kind), INDEX), "index", 1024)
    blocks = Stage(points.df.filter("asks").select("vid", "vector").repartition(F.xxhash64("vid") % (total // (every * QUERY_ROWS) + 1)).mapInArrow(_blocks(kind), "dim int, query_ids binary, queries binary"), "queries", 1024)
    spread = blocks.df.withColumn("part", F.explode(F.sequence(F.lit(0), count.cast("int") - 1))).withColumn("shard", F.concat_ws("-", "dim", "part")).drop("dim", "part")
    # Blocks are small where Spark guesses their size, before each is repeated for every shard: a broadcast would fill the driver.
    pairs = spread.join(index.df.hint("merge"), "shard")
    hits = Stage(pairs.mapInArrow(_search(k + 1, width, longest, kind), "query long, vid long, score double"), "hits", 4)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vid")
    best = hits.df.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).join(points.df.select("vid", "ids"), "vid")
    listed = best.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("nth") <= k + 1)
    lists = listed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    groups = points.df.filter("asks").select("vector", F.col("vid").alias("query"), "n")
    asking = join_by_group(named.df.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vector"), groups, "vector", "n", total)
    sized = points.df.filter("asks").select(F.col("vid").alias("query"), F.col("n").alias("size"))
    answers = join_by_group(asking.select("query_id", "query"), lists.join(sized, "query"), "query", "size", total)
    others = F.slice(F.filter("found", lambda f: f.vec_id != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), "hit.vec_id", "hit.score")
