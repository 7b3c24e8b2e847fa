"""Best-fit decreasing packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_BATCH, Stage, tidy

CAPACITY = 2048
END = 0
BUCKET_ROWS = 4096
MAX_BUCKETS = 4096

#: The byte-level split of the vocabulary's tokenizer; and the same without its look-ahead, for texts
#: without two white spaces in a row, where both split alike.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SPLIT_SIMPLE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to ids, as ``tokenizers`` gives them for a byte-level BPE file without added special tokens.

    The file's vocabulary and merges go to a faster engine for the same algorithm, which takes merges by
    rank; that their order is the ids' order is checked. Strings of the file's special tokens get their ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in byte for c in token)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {k: v for k, v in ranks.items() if v not in special.values()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    order = [spec["model"]["vocab"]["".join(m)] for m in merges]
    if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"] or order != sorted(order):
        raise ValueError(f"{path} isn't a byte-level BPE whose ids follow its merges")
    exact, simple = (tiktoken.Encoding(f"{path}-{i}", pat_str=p, mergeable_ranks=ranks, special_tokens=special) for i, p in enumerate((SPLIT, SPLIT_SIMPLE)))
    double = regex.compile(r"\s\s")
    marked = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")

    def encode(text: str) -> np.ndarray:
        if marked.search(text):
            return np.array(exact.encode(text, allowed_special="all"), dtype=np.uint32)
        return (exact if double.search(text) else simple).encode_to_numpy(text, disallowed_special=()).astype("<u4")

    return encode


def _pieces(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : first + piece * capacity]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


class OpenBins:
    """A segment tree over remaining capacities: which have open bins, and the least that suffices."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        at = room + self.size
        self.any[at] = bool(self.bins[room])
        while at := at >> 1:
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def put(self, room: int, low: int, high: int) -> None:
        if low < high:
            self.bins[room].append((low, high))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        found = self.bins[room].pop()
        self._mark(room)
        return found

    def tightest(self, length: int) -> int | None:
        at = length + self.size
        while not self.any[at]:
            while at & 1:
                at >>= 1
                if not at:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at + (not self.any[2 * at])
        return at - self.size


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing for so many items of each length, equal items and equal bins taken together.

    Rows of (length, first item, items, first bin, items a bin, offset): items of a length are
    numbered from 0. Placed one by one, an item goes to the open bin with the least room that suffices, and
    the next of its length to the same bin as long as it has room; so bins of equal room are filled in
    one step. Steps depend on the number of lengths and capacities, not of items.
    """
    bins, following, steps = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        left, item = counts[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room, new = capacity, -(-left // (capacity // length))
                bins.put(room, following, following + new)
                following += new
            low, high = bins.take(room)
            each = room // length
            full = min(high - low, left // each)
            if full:
                steps.append((length, item, full * each, low, each, capacity - room))
                bins.put(room - each * length, low, low + full)
                item, left, low = item + full * each, left - full * each, low + full
            if left and low < high:
                steps.append((length, item, left, low, left, capacity - room))
                bins.put(room - left * length, low, low + 1)
                item, left, low = item + left, 0, low + 1
            bins.put(room, low, high)
    return np.array(steps, dtype=np.int64).reshape(-1, 6)


def _place(plan):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = plan.value[np.lexsort((plan.value[:, 1], plan.value[:, 0]))]
        for batch in batches:
            length, item = (np.asarray(batch.column(i)) for i in (3, 5))
            at = np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                of = length == n
                low, high = np.searchsorted(steps[:, 0], [n, n + 1])
                at[of] = low + np.searchsorted(steps[low:high, 1], item[of], side="right") - 1
            of = steps[at]
            nth = item - of[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(of[:, 3] + nth // of[:, 4]), pa.array(of[:, 5] + nth % of[:, 4] * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return place


@tidy
def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into as few sequences of ``capacity`` tokens as best-fit decreasing gives.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A document's ids are
    followed by id 0; one with more than ``capacity`` is cut into pieces of that length, of which only the first may
    be shorter. The plan is made on the driver from the number of pieces of each length, a table of
    ``capacity`` rows at most, and holds for all pieces at once, however many. Pieces of a length
    are numbered by a prefix sum over hash buckets of the ids, so that a common length spreads over tasks.

    Null and empty texts are the one id 0. Repeated rows are packed each; a null id is kept. Long
    texts are encoded whole. An empty table gives no rows. Other columns aren't read. ``tokenizer`` is
    the path of a byte-level BPE file that executors can read too.
    """
    spark = docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = Stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(tokenizer, capacity), schema), "pieces", TEXT_BATCH)
    buckets = max(16, min(MAX_BUCKETS, pieces.count() // BUCKET_ROWS))
    rows = pieces.df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sums = Stage(rows.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in sums.df.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.df.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = rows.withColumn("nth", F.row_number().over(within)).join(starts, ["length", "bucket"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("nth") - 1).alias("item"))
    plan = spark.sparkContext.broadcast(best_fit(counts, capacity))
    return numbered.mapInArrow(_place(plan), f"{schema}, sequence_id long, offset long")
