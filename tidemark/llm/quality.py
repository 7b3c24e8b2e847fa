"""Quality by co-training: a view of the words and a view of what surrounds them teach each other."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_BATCH, TEXT_BATCH, Stage, batches_of, summed, tidy
from .models import derivatives, linear, logistic_regression, logit, newton, platt, sigmoid
from .toxicity import held_out

#: Labelled rows that the two classifiers are fitted on at most. Rows without a label all take part.
FIT_ROWS = 20_000
ROUNDS = 3
#: Of the pool, the share that each view passes on in a round, and the confidence that takes.
PASSED = 0.1
CONFIDENT = 0.95
#: Log-odds are counted in bins of this width up to the largest; rows of the bin that completes the share all pass.
BIN, MOST = 0.005, 30
BINS = int(MOST / BIN) + 1
#: Weight of a row with a pseudo-label.
PSEUDO = 0.5
CUT = 0.5

SHAPES, SOURCES, LANGS = 192, 64, 16
CONTENT = SHAPES + 3
METADATA = SOURCES + LANGS + 5

_RUNS = ((re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_]+"), "A"), (re.compile(r"\d+"), "9"))


class Shapes(dict):
    """The bucket of a word's shape: its runs of letters, capitals and digits folded, its signs as they stand, and its length in steps."""

    def __missing__(self, word: str) -> int:
        shape = word
        for pattern, sign in _RUNS:
            shape = pattern.sub(sign, shape)
        if len(self) > 500_000:
            self.clear()
        self[word] = found = zlib.crc32(f"{shape}{min(len(word), 24) // 4}".encode()) % SHAPES
        return found


def content(text: str | None, shapes: Shapes) -> np.ndarray:
    """The view of the text's words, with the signs that stand in them: shares of their shapes, and how much words repeat."""
    out = np.zeros(CONTENT, dtype=np.float32)
    own = (text or "").split()
    if n := len(own):
        out[:SHAPES] = np.bincount(list(map(shapes.__getitem__, own)), minlength=SHAPES) / n * 4
        distinct = len(set(own))
        out[SHAPES:] = [distinct / n, sum(map(eq, own, own[1:])) / n * 4, distinct / n**0.7]
    return out


def metadata(source: str | None, lang: str | None, text: str | None) -> np.ndarray:
    """The view of the page without its words: where it comes from, its size, its lines and its blanks."""
    out = np.zeros(METADATA, dtype=np.float32)
    out[zlib.crc32(repr(source).encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32(repr(lang).encode()) % LANGS] = 1
    text = text or ""
    chars, lines, blanks = len(text), text.count("\n") + 1, text.count(" ") + text.count("\n")
    out[SOURCES + LANGS :] = [np.log1p(chars) / 4, np.log1p(lines), np.log1p(chars / lines) / 3, blanks / max(chars, 1) * 4, chars < 60]
    return out


def _features(batch: pa.RecordBatch, shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    source, lang, text = (c.to_pylist() for c in batch.columns[-3:])
    return np.stack([content(t, shapes) for t in text]), np.stack([metadata(*x) for x in zip(source, lang, text, strict=True)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = Shapes()
    for batch in batches:
        if batch.num_rows:
            a, b = _features(batch, shapes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary())], [*batch.schema.names[:-3], "content", "metadata"])


def _bins(margin: np.ndarray) -> np.ndarray:
    """Bins of log-odds for label 1; -1 for those against it."""
    return np.where(margin < 0, -1, np.clip(margin, 0, MOST) / BIN).astype(np.int64)


def _given(views: list[np.ndarray], rules: list, i: int) -> np.ndarray:
    """What the other view has told view ``i`` in all rounds: 0, 1 or, of rows it isn't sure of, -1. Later rounds win."""
    out = np.full(len(views[0]), -1)
    for betas, limits in rules:
        margin = linear(views[1 - i].astype(np.float64), betas[1 - i])
        for label, side in ((1, margin), (0, -margin)):
            out[_bins(side) >= limits[1 - i][label]] = label
    return out


def _counts(views: list[np.ndarray], betas: list[np.ndarray]) -> np.ndarray:
    """Rows by view, label and bin."""
    out = np.zeros((2, 2, BINS))
    for i in (0, 1):
        margin = linear(views[i].astype(np.float64), betas[i])
        for label, side in ((1, margin), (0, -margin)):
            at = _bins(side)
            out[i, label] = np.bincount(at[at >= 0], minlength=BINS)
    return out.ravel()


def _sums(views: list[np.ndarray], rules: list, betas: list[np.ndarray]) -> np.ndarray:
    """Gradient, Hessian and number of the pseudo-labelled rows, for one view after the other."""
    out = []
    for i in (0, 1):
        label = _given(views, rules, i)
        at = label >= 0
        x = np.column_stack([views[i][at], np.ones(at.sum())]).astype(np.float64)
        slope, curve = derivatives(x, label[at], np.full(len(x), PSEUDO), betas[i])
        out += [slope, curve.ravel(), [len(x)]]
    return np.concatenate(out)


class LocalPool:
    """Rows without a label, as arrays."""

    def __init__(self, views: list[np.ndarray]):
        self.views, self.size = views, len(views[0])

    def total(self, measure, *given) -> np.ndarray:
        return measure(self.views, *given)


class Pool:
    """Rows without a label, as a table ``content, metadata``; measures are summed over all of them in Spark."""

    def __init__(self, rows: DataFrame):
        self.rows, self.size = rows, rows.count()

    def total(self, measure, *given) -> np.ndarray:
        with batches_of(self.rows.sparkSession, ROW_BATCH):
            return summed(self.rows, _measured, measure, *given)


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(c.to_pylist()), dtype=np.float32).reshape(batch.num_rows, -1) for c in batch.columns[-2:]]


def _measured(batch: pa.RecordBatch, measure, *given) -> np.ndarray:
    return measure(_views(batch), *given)


class CoTraining:
    """Two classifiers on two views of the same rows; each labels for the other what it is surest of."""

    def __init__(self, rounds: int = ROUNDS):
        self.rounds = rounds

    def fit(self, views: list[np.ndarray], y: np.ndarray, pools, check: np.ndarray) -> CoTraining:
        """``check`` marks labelled rows that are kept: half of them calibrate each view, the others weigh both; ``pools`` is a pool or its two views."""
        pool = LocalPool(pools) if isinstance(pools, list) else pools
        train, rules = ~check, []
        rate = y[train].mean()
        own = [np.column_stack([v[train], np.ones(train.sum())]).astype(np.float64) for v in views]
        self.betas, self.passed, self.pool = [logistic_regression(v[train], y[train]) for v in views], [0, 0], pool.size
        for _ in range(self.rounds if pool.size else 0):
            counts = pool.total(_counts, self.betas).reshape(2, 2, BINS)
            rules.append((self.betas, [[self._limit(counts[i, label], pool.size * share) for label, share in ((0, 1 - rate), (1, rate))] for i in (0, 1)]))
            self._refit(own, y[train], pool, rules)
        scale, join = np.flatnonzero(check)[::2], np.flatnonzero(check)[1::2]
        if len(set(y[scale])) < 2 or len(set(y[join])) < 2:
            scale = join = np.flatnonzero(check)
        self.scales = [platt(linear(v[scale], b), y[scale]) for v, b in zip(views, self.betas, strict=True)]
        self.joint = logistic_regression(np.column_stack(self.margins([v[join] for v in views])), y[join], penalty=0.1)
        return self

    @staticmethod
    def _limit(counts: np.ndarray, rows: float) -> int:
        """The least bin that passes."""
        upward = np.cumsum(counts[::-1])[::-1]
        full = np.flatnonzero(upward >= np.ceil(PASSED * rows))
        return max(int(full[-1]) if len(full) else 0, int(np.ceil(logit(CONFIDENT) / BIN)))

    def _refit(self, own: list[np.ndarray], y: np.ndarray, pool, rules: list, steps: int = 10) -> None:
        """Newton's method for both views at once, from where they stand; one pass over the pool a step."""
        betas = list(self.betas)
        for _ in range(steps):
            sums, sizes, at = pool.total(_sums, rules, betas), [], 0
            for i in (0, 1):
                n = len(betas[i])
                slope, curve = derivatives(own[i], y, np.ones(len(y)), betas[i])
                slope, curve = slope + sums[at : at + n], curve + sums[at + n : at + n + n * n].reshape(n, n)
                self.passed[i] = int(sums[at + n + n * n])
                at += n + n * n + 1
                betas[i], size = newton(slope, curve, betas[i], 1.0)
                sizes.append(size)
            if max(sizes) < 1e-4:
                break
        self.betas = [np.round(b, 8) for b in betas]  # sums over tasks differ in their last digits

    def margins(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """Calibrated log-odds of each view."""
        return [np.clip(linear(linear(v.astype(np.float64), b)[:, None], s), -12, 12) for v, b, s in zip(views, self.betas, self.scales, strict=True)]

    def scores(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.margins(views)
        return sigmoid(a), sigmoid(b), sigmoid(linear(np.column_stack([a, b]), self.joint))


def _scored(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = model.value.scores(_views(batch)) if model.value else [np.full(batch.num_rows, 0.5)] * 3
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *[pa.array(x) for x in got]], [*batch.schema.names[:-2], "content_score", "metadata_score", "score"])

    return score


def fit(rows: DataFrame, labels: DataFrame, fit_rows: int) -> CoTraining | None:
    """Of rows ``doc_id, content, metadata``; None where the labelled rows don't hold both classes."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    learnt = Stage(known.filter(~held_out()).join(rows.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "fit").df
    got = sorted(rows.join(F.broadcast(learnt), "doc_id").select("quality", "content", "metadata").collect())  # fit_rows at most
    y = np.array([r[0] for r in got])
    check = np.arange(len(y)) % 4 == 3
    if len(set(y[check])) < 2 or len(set(y[~check])) < 2:
        return None
    views = [np.stack([np.frombuffer(r[i], dtype=np.float32) for r in got]) for i in (1, 2)]
    pool = Stage(rows.join(known, "doc_id", "left_anti").select("content", "metadata"), "pool")
    model = CoTraining().fit(views, y.astype(np.float64), Pool(pool.df), check)
    pool.drop()
    return model


@tidy
def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score every document: ``doc_id, held_out, content_score, metadata_score, score, keep``.

    Scores are the calibrated chances of quality 1, by the words, by source, language, size, lines and
    blanks, and by both; ``keep`` is 1 from 0.5 on. Labels are learnt from rows outside the held-out third,
    ``fit_rows`` at most, a quarter of which only calibrates: one half of it each view, the other half their combination. Pseudo-labels go to all rows without labels: each
    round counts both views' log-odds over all of them, and fits on sums of gradients and Hessians of those
    that are sure enough. Every row is scored on its whole text.

    Null texts count as empty; null sources and languages are values of their own. Repeated rows get equal
    scores. Without labels of both classes all scores are 0.5. An empty table gives no rows. Columns other than
    doc_id, text, source and lang aren't read.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    rows = Stage(plain.mapInArrow(_rows, "doc_id long, content binary, metadata binary"), "views", TEXT_BATCH).df
    model = spark.sparkContext.broadcast(fit(rows, labels, fit_rows))
    schema = "doc_id long, held_out boolean, content_score double, metadata_score double, score double"
    return rows.select("doc_id", held_out().alias("held_out"), "content", "metadata").mapInArrow(_scored(model), schema).withColumn("keep", (F.col("score") >= CUT).cast("int"))
