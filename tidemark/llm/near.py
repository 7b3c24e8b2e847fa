"""Near copies by the Jaccard similarity of word shingles: SimHash by Golay keys, MinHash bands for what lies beyond its reach, an exact bound by parity sketches, exact verification, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BATCH, Stage, batches_of, join_by_group, salted_join, sheltered, tidy
from .graph import components
from .groups import ALIKE, WORDS, members_of, roots_of
from .simhash import fingerprint_links, voted

SHINGLE = 5
#: At a similarity of 0.8, sixteen bands of four independent rows bring 99.98 % of pairs together.
BANDS, ROWS = 16, 4
#: Shingles whose signatures are computed at once.
BLOCK = 256
LAST = (1 << 63) - 1

_RANDOM = np.random.default_rng(0x71DE)
_PLACES = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_FIRST, _SECOND = (_RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))
_MIX = np.uint64(0x94D049BB133111EB)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's runs of ``width`` words; fewer words are one run, no words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    own = np.array([digest(w) for w in words], dtype=np.uint64)
    width = min(width, len(own))
    h = np.zeros(len(own) - width + 1, dtype=np.uint64)
    for i in range(width):
        h += own[i : i + len(h)] * _PLACES[i]
        h ^= h >> np.uint64(31)
    h *= _MIX
    return np.unique(h ^ h >> np.uint64(32))


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of signatures, each the least shingle in an order of its own."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(own), BLOCK):
        x = own[start : start + BLOCK, None] * _FIRST
        x ^= x >> np.uint64(32)
        x *= _SECOND
        np.minimum(least, x.min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of how many shingles fall in each place: two sketches differ in no more places than two sets in shingles."""
    odd = np.bincount((own % np.uint64(WORDS * 64)).astype(np.int64), minlength=WORDS * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def alike(same: int, a: int, b: int) -> bool:
    up, down = ALIKE
    return (up + down) * same >= up * (a + b)


_NAMES = [f"w{i}" for i in range(WORDS)]


def _signed(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            keys = pa.array([bands(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
            prints = pa.array(np.array([voted(s) for s in sets], dtype=np.uint64).view(np.int64))
            places = np.array([sketch(s) for s in sets], dtype=np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int32()), prints, keys, *[pa.array(np.ascontiguousarray(places[:, i])) for i in range(WORDS)]], ["row", "rank", "node", "size", "fp", "bands", *_NAMES])

    return sign


def _sets(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["node", "own"])

    return cut


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(4), batch.column(5), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
            keep.append(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
        yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "ra", "rb"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs ``a, b, ra, rb`` of nodes, a written table, those that are alike, exactly."""
    left = salted_join(pairs, sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a", pairs, ["a", "b"])
    both = salted_join(left, sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b", pairs, ["a", "b"])
    return both.select("a", "b", "ra", "rb", "x", "y").mapInArrow(_checked, "a long, b long, ra long, rb long")


def _keyed(nodes: DataFrame, total: int) -> DataFrame:
    """``nid, bands`` of ``node, fp, bands``, with one more key: nodes share it whose fingerprints are within three bits, over any number of steps."""
    named = nodes.filter("bands is not null").select(F.col("node").alias("nid"), "fp", "bands")
    prints = Stage(named.groupBy("fp").agg(F.count("*").alias("n")), "prints")
    roots = components(fingerprint_links(prints.df.select("fp"))).select(F.col("node").alias("fp"), "root")
    groups = prints.df.join(roots, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"))
    return join_by_group(named, groups, "fp", "n", total).select("nid", F.concat("bands", F.array(F.xxhash64(F.lit(BANDS), "root"))).alias("bands"))


@tidy
def near_copies(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``node, root, first`` of documents ``row, rank, text``, one row per distinct set of shingles: ``first`` is the least (rank, row) that has it.

    Texts with equal sets are one node. A node's fingerprint is the SimHash of its shingles; what Golay keys connect within three bits
    is a band like those of MinHash, which bring together what lies further apart. Nodes that share a band are compared by sketch, which rules out only what can't be
    alike, and verified on the whole sets, as ``roots_of`` says; no pair of a band is left out.
    """
    words = ", ".join(f"{n} long" for n in _NAMES)
    signed = Stage(docs.mapInArrow(_signed(width), f"row long, rank long, node long, size int, fp long, bands array<long>, {words}"), "signed", TEXT_BATCH)
    nodes = Stage(signed.df.groupBy("node").agg(F.min(F.struct("rank", "row")).alias("first"), *[F.first(c).alias(c) for c in ("size", "fp", "bands", *_NAMES)]), "nodes")
    signed.drop()
    keyed = Stage(_keyed(nodes.df, nodes.count()), "keyed")
    held, two = members_of(keyed.df, BANDS + 1)
    keyed.drop()
    members = Stage(held.df.join(nodes.df.select(F.col("node").alias("nid"), "size", *_NAMES), "nid").withColumn("root", F.col("nid")), "members")
    wanted = held.df.select(F.col("nid").alias("node")).unionByName(two.df.select(F.explode(F.array("a", "b")).alias("node"))).distinct().join(nodes.df, "node").select("node", F.col("first.rank").alias("rank"), F.col("first.row").alias("row"))
    texts = docs.join(wanted, ["rank", "row"]).groupBy("node").agg(F.first("text").alias("text"))
    sets = Stage(texts.mapInArrow(_sets(width), "node long, own binary"), "sets", TEXT_BATCH)
    held.drop()
    with batches_of(docs.sparkSession, TEXT_BATCH):
        roots = roots_of(members, two, lambda pairs: _verified(pairs, sets.df))
    sets.drop()
    return nodes.df.select("node", "first").join(roots.df, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """The input's rows, with all its columns, of which one of each group of near copies stays.

    Near copies have sets of ``width``-word shingles of Jaccard similarity 0.8 or more, or are so over steps of such
    documents; the smallest id stays, a null id only where there is no other. Texts without words are
    copies of each other. Of rows that repeat id and text one stays. Texts are read whole.
    """
    rows = sheltered(docs, id_col, text_col)
    keyed = rows.withColumns({"_row": F.xxhash64(text_col), "_rank": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))})
    found = near_copies(keyed.select(F.col("_row").alias("row"), F.col("_rank").alias("rank"), F.col(text_col).alias("text")))
    kept = Stage(found.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rank").alias("_rank"), F.col("first.row").alias("_row")), "kept").df
    return keyed.join(kept, ["_rank", "_row"], "left_semi").dropDuplicates(["_rank", "_row"]).select(rows.columns).toDF(*docs.columns)
