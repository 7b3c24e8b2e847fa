"""Removal of passages that an earlier document holds: winnowed seeds, extended both ways."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BATCH, Stage, join_by_group, sheltered, tidy

WINDOW = 50
SEED_WORDS = 8
LAST = (1 << 63) - 1

_BASE = np.uint64(0x9E6C63D0876A9A6B)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        # The constants of SplitMix64.
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(2 * n, base, dtype=np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=np.uint64)
    return _powers


class Words:
    """A text's words by hash, so that any run of them has a hash of its own."""

    def __init__(self, text: str | None):
        self.words = (text or "").encode().split()
        digest = xxhash.xxh64_intdigest
        self.hashes = np.array([digest(w) for w in self.words], dtype=np.uint64)
        n = len(self.words)
        up, self.down = _power(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mixed(self.hashes) * up[:n], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] ^ (end - start).astype(np.uint64))

    def units(self, window: int, seed: int) -> tuple[np.ndarray, ...] | None:
        """Anchor, unit, first and last window, one row for each run of windows with one seed.

        A window's seed is the run of ``seed`` words in it with the least hash, the leftmost of equal ones: a
        function of the window's words alone. The unit is the hash of all words of the run's windows and
        of the seed's place among them.
        """
        n = len(self.words)
        if n < window:
            return None
        at = np.arange(n - seed + 1)
        grams = self.runs(at, at + seed)
        place = np.lib.stride_tricks.sliding_window_view(grams, window - seed + 1).argmin(axis=1) + np.arange(n - window + 1)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        seeds = place[first]
        unit = mixed(self.runs(first, last + window) + (seeds - first).astype(np.uint64))
        return mixed(~grams[seeds]), unit, first, last


def _rows(batch: pa.RecordBatch):
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _arrays(parts: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    if parts:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)


def _units(window: int, seed: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for row, rank, text in _rows(batch):
                if found := Words(text).units(window, seed):
                    anchor, unit, first, last = found
                    parts.append((anchor, unit, np.full(len(first), rank), np.full(len(first), row), first.astype(np.int32), (last + window).astype(np.int32)))
            yield from _arrays(parts, ["anchor", "unit", "rank", "row", "low", "high"])

    return scan


def _windows(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``rank, row, text, asked``: every window of the stretches asked for, by the anchor it holds."""
        for batch in batches:
            parts = []
            for rank, row, text, asked in _rows(batch):
                words = Words(text)
                for a in asked:
                    start = np.arange(a["low"], a["high"] - window + 1)
                    parts.append((np.full(len(start), a["anchor"]), words.runs(start, start + window), np.full(len(start), rank), np.full(len(start), row), start.astype(np.int32)))
            yield from _arrays(parts, ["anchor", "window", "rank", "row", "low"])

    return scan


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str | None], list[list[bytes]], list[np.ndarray]]]:
    """Per batch of (row's own columns.., text, lows, highs): words and which of them go."""
    for batch in batches:
        words, gone = [], []
        for text, lows, highs in zip(*(batch.column(c).to_pylist() for c in ("text", "lows", "highs")), strict=True):
            own = (text or "").encode().split()
            step = np.zeros(len(own) + 1, dtype=np.int64)
            np.add.at(step, np.array(lows or [], dtype=np.int64), 1)
            np.add.at(step, np.array(highs or [], dtype=np.int64), -1)
            words.append(own)
            gone.append(np.cumsum(step)[: len(own)] > 0)
        yield batch, words, gone


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, words, gone in _ranges(batches):
        kept = [b" ".join(w for w, g in zip(own, out, strict=True) if not g) if out.any() else b" ".join(own) for own, out in zip(words, gone, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, words, gone in _ranges(batches):
        texts = [b" ".join(w for w, g in zip(own, out, strict=True) if not g).decode() if out.any() else text for text, own, out in zip(batch.column("text").to_pylist(), words, gone, strict=True)]
        yield batch.drop_columns(["lows", "highs"]).set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


@tidy
def _ranges_of(source: DataFrame, window: int, seed: int) -> DataFrame:
    """``rank, row, lows, highs``: the words to remove of documents ``row, rank, text`` that lose any."""
    units = Stage(source.mapInArrow(_units(window, seed), "anchor long, unit long, rank long, row long, low int, high int"), "units", TEXT_BATCH)
    groups = Stage(units.df.groupBy("anchor", "unit").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("n")), "groups")
    total = units.count()

    several = groups.df.groupBy("anchor").agg(F.count("*").alias("units"), F.min("first").alias("low"), F.max("first").alias("high")).filter("units > 1 and low < high").select("anchor", "units")
    closer = join_by_group(groups.df, several, "anchor", "units", total).select("anchor", "unit", "first", "n", F.lit(True).alias("several"))
    copied = groups.df.filter("first < last").select("anchor", "unit", "first", "n", F.lit(False).alias("several"))
    asked = closer.unionByName(copied).groupBy("anchor", "unit").agg(F.min("first").alias("first"), F.min("n").alias("n"), F.max("several").alias("several"))
    met = Stage(join_by_group(units.df, asked, ["anchor", "unit"], "n", total).filter("rank > first or several").select("rank", "row", "anchor", "low", "high", (F.col("rank") > F.col("first")).alias("copy")), "met")
    units.drop()
    groups.drop()
    whole = met.df.filter("copy").select("rank", "row", "low", "high")
    stretches = met.df.filter("not copy").groupBy("rank", "row").agg(F.collect_list(F.struct("anchor", "low", "high")).alias("asked"))  # one text's at most
    windows = Stage(source.join(stretches, ["rank", "row"]).select("rank", "row", "text", "asked").mapInArrow(_windows(window), "anchor long, window long, rank long, row long, low int"), "windows", TEXT_BATCH)
    least = windows.df.groupBy("anchor", "window").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("n")).filter("first < last").drop("last")
    part = join_by_group(windows.df, least, ["anchor", "window"], "n", windows.count()).filter("rank > first").select("rank", "row", "low", (F.col("low") + window).alias("high"))

    return whole.unionByName(part).groupBy("rank", "row").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))


def _marked(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """``docs`` (any columns, among them doc_id and text) with arrays ``lows`` and ``highs`` of the words to remove."""
    keyed = docs.withColumns({"_row": F.xxhash64("text"), "_rank": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))})
    ranges = _ranges_of(keyed.select(F.col("_row").alias("row"), F.col("_rank").alias("rank"), "text"), window, seed)
    return keyed.join(ranges.withColumnsRenamed({"row": "_row", "rank": "_rank"}), ["_rank", "_row"], "left").drop("_row", "_rank")


def repeated_passages(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of each document without passages of ``window`` words or more that a document of smaller id holds.

    One row per input row: ``doc_id, n_words, n_removed, kept_sha256``. Every window of words has a winnowed
    seed in it; windows with the same seed form a unit. Units that are equal with all their words
    are copies as a whole. Where a seed stands in different units, texts are joined to these seeds, the first occurrence of each
    unit is extended both ways, window by window, and equal windows meet by their hash under the seed's. Copies don't pair up: each
    unit and window has its least id by a partial aggregate. Windows are compared with those of one seed alone, so that
    only equal hashes within a seed's few windows could be taken for equal words.
    Everything is judged on the input; removed ranges are the union, so they are maximal.

    Null texts have no words; texts of fewer words keep all. A null id comes after all others. Rows that
    repeat an id aren't compared with each other; equal rows lose the same words. Long texts are taken whole,
    and an empty table gives no rows. Other columns aren't read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return Stage(_marked(plain, window, seed).select("doc_id", "text", "lows", "highs").mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string"), "passages", TEXT_BATCH).df


def cut_repeated_passages(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """The input's rows and columns with those passages cut from ``text``; a text that loses any has its words joined by one space."""
    safe = sheltered(docs, "doc_id", "text")
    return Stage(_marked(safe, window, seed).mapInArrow(_cut, safe.schema), "passages", TEXT_BATCH).df.toDF(*docs.columns)
