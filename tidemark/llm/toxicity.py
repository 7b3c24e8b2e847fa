"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_BATCH, TEXT_BATCH, Stage, batches_of, sheltered, summed, tidy
from .models import LabelModel, derivatives, linear, newton, sigmoid

#: Labelled rows that voters are mined from at most: those with the least hashes of their ids.
FIT_ROWS = 20_000
#: Word stems that become voters at most; the evidence (log-likelihood ratio) and share of toxic rows that one needs.
MOST_STEMS = 256
LEAST_EVIDENCE = 24.0
#: Ridge of the regression on posterior labels.
RIDGE = 0.3
LEAST_SHARE = 0.75
STEM = range(3, 9)
CUT = 0.7

#: English insults.
LEXICON = "clown disgusting dumb filth idiot imbecile jerk loser moron pathetic scum stupid trash vermin worthless".split()

_WORD = re.compile(r"[^\W\d_]+")
#: Patterns of address and of shouting, which vote as well.
PATTERNS = {
    "threat": re.compile(r"\b(?:kill|hurt|destroy)\s+(?:you|them|him|her)\b"),
    "address": re.compile(r"\byou(?:'re|\s+are)?\s+(?:a|an|all|such|so)\s+\w+"),
    "hostile": re.compile(r"\b(?:shut up|go away|hate you|hate them)\b"),
    "shout": re.compile(r"!!"),
}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def stems(word: str) -> list[str]:
    """The whole word, and its beginnings, marked by a star."""
    return [word, *[word[:n] + "*" for n in STEM if n < len(word)]]


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean rows that each stem stands in."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[toxic].update({s for w in set(words(text)) for s in stems(w)})
    names = list(counts[0] | counts[1])
    for start in range(0, len(names), 50_000):
        part = names[start : start + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([counts[i][s] for s in part], pa.int64()) for i in (1, 0)]], ["stem", "toxic", "clean"])


def weighed(counted: DataFrame, all_toxic: int, all_clean: int) -> DataFrame:
    """Of ``stem, toxic, clean`` those that speak for toxic rows, with their evidence: the log-likelihood ratio against equal rates."""
    total = all_toxic + all_clean
    term = lambda part, size, rate: F.when(part > 0, part * F.log(part / (size * rate))).otherwise(0.0)
    n = (F.col("toxic") + F.col("clean")) / F.lit(float(total))
    parts = [term(F.col(c).cast("double"), F.lit(float(size)), n) + term(F.lit(float(size)) - F.col(c), F.lit(float(size)), 1 - n) for c, size in (("toxic", all_toxic), ("clean", all_clean))]
    often = F.col("toxic") / F.lit(float(max(all_toxic, 1)))
    share = often / (often + (F.col("clean") + 0.5) / F.lit(float(max(all_clean, 1))))
    return counted.filter("toxic > 0").withColumn("evidence", F.round(2 * (parts[0] + parts[1]), 6)).filter((share >= LEAST_SHARE) & (F.col("evidence") >= LEAST_EVIDENCE))


def choose(scored: list[tuple[str, float]], most: int = MOST_STEMS) -> list[str]:
    """Stems with the most evidence; none that begins with another or is another's beginning."""
    chosen: list[str] = []
    for stem, _ in sorted(scored, key=lambda x: (-x[1], -len(x[0]) - (not x[0].endswith("*")), x[0])):
        base = stem.rstrip("*")
        if len(chosen) < most and not any(base.startswith(c.rstrip("*")) or c.rstrip("*").startswith(base) for c in chosen):
            chosen.append(stem)
    return chosen


class Features:
    """Counts of chosen stems in a text, and what follows from them."""

    def __init__(self, chosen: list[str]):
        self.names = sorted({*chosen, *LEXICON})
        self.at = {s: i for i, s in enumerate(self.names)}
        self.known: dict[str, int] = {}

    def _find(self, word: str) -> int:
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[word] = found = next((self.at[s] for s in stems(word) if s in self.at), -1)
        return found

    def counts(self, text: str | None) -> tuple[list[int], int]:
        own = words(text)
        known = self.known
        return [i for w in own if (i := known[w] if w in known else self._find(w)) >= 0], len(own)

    def row(self, text: str | None) -> np.ndarray:
        """Presence of each stem, then steps and rate of all hits, then patterns."""
        hits, n = self.counts(text)
        out = np.zeros(len(self.names) + 5 + len(PATTERNS), dtype=np.float32)
        out[hits] = 1
        lower = (text or "").lower()
        out[len(self.names) :] = [len(hits) >= 1, len(hits) >= 2, len(hits) >= 3, np.log1p(len(hits)), min(len(hits) / max(n, 1) * 20, 2), *[bool(p.search(lower)) for p in PATTERNS.values()]]
        return out

    def votes(self, rows: np.ndarray) -> np.ndarray:
        """One voter per stem; one for none at all, for a high rate, for several; and the patterns."""
        k = len(self.names)
        any_, rate, several = rows[:, k] > 0, rows[:, k + 4], rows[:, k + 2] > 0
        return np.column_stack([rows[:, :k], np.where(any_, 0, -1), np.where(rate > 0.1, 1, np.where(rate < 0.02, -1, 0)), np.where(several, 1, 0), rows[:, k + 5 :] * 1]).astype(np.int8)


def _rows(features):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = features.value
        for batch in batches:
            rows = [own.row(t).tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.binary())], [*batch.schema.names[:-1], "row"])

    return build


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(len(column), -1)


def _voted(batch: pa.RecordBatch, features: Features, measure) -> np.ndarray:
    """``measure`` of a batch of ``row, label, n``."""
    return measure(features.votes(_matrix(batch.column(0))).astype(np.float64), np.asarray(batch.column(1)), np.asarray(batch.column(2)).astype(np.float64))


def _slopes(batch: pa.RecordBatch, features: Features, labels: LabelModel, beta: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the loss on posterior labels."""
    x = _matrix(batch.column(0)).astype(np.float64)
    post = labels.posterior(features.votes(x).astype(np.float64), np.asarray(batch.column(1)))
    slope, curve = derivatives(np.column_stack([x, np.ones(len(x))]), post, np.asarray(batch.column(2)).astype(np.float64), beta)
    return np.concatenate([slope, curve.ravel()])


def _scores(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = sigmoid(linear(_matrix(batch.column(batch.num_columns - 1)).astype(np.float64), model.value))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values)], [*batch.schema.names[:-1], "score"])

    return score


def held_out(id_: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_).cast("string")) % 3 == 1, F.lit(False))


def voters(docs: DataFrame, known: DataFrame, fit_rows: int = FIT_ROWS, most_stems: int = MOST_STEMS) -> Features:
    """The lexicon, the patterns, and stems mined from ``fit_rows`` labelled rows ``doc_id, toxic`` of ``known``."""
    chosen_rows = Stage(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "fit")
    texts = docs.join(F.broadcast(chosen_rows.df), "doc_id").filter(F.col("text").isNotNull())  # fit_rows bounds the broadcast
    sample = Stage(texts.groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text"), "fit")  # a text that was copied counts once
    chosen_rows.drop()
    sizes = {r.toxic: r.n for r in sample.df.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    all_toxic, all_clean = sizes.get(1, 0), sizes.get(0, 0)
    scored: list[tuple[str, float]] = []
    if all_toxic and all_clean:
        counted = sample.df.mapInArrow(_mine, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        least = max(3, all_toxic // 500)
        scored = [(r.stem, r.evidence) for r in weighed(counted.filter(F.col("toxic") >= least), all_toxic, all_clean).collect()]  # stems of fit_rows texts that pass
    sample.drop()
    return Features(choose(scored, most_stems))


def fit(rows: DataFrame, known: DataFrame, features: Features) -> np.ndarray:
    """Coefficients from all rows ``doc_id, row`` outside the held-out third, labelled or not.

    Equal rows with equal labels are counted together. The label model finds every row's posterior label from its voters
    and, where there is one, its label; a regression is fitted to these.
    """
    size = len(features.names) + 5 + len(PATTERNS)
    spark = rows.sparkSession
    labelled = rows.filter(~held_out()).join(known, "doc_id", "left").select("row", F.coalesce("toxic", F.lit(-1)).cast("int").alias("label"))
    counted = Stage(labelled.groupBy("row", "label").agg(F.count("*").alias("n")), "patterns")
    classes = {r.label for r in counted.df.select("label").distinct().collect()}  # three at most
    beta = np.zeros(size + 1)
    if not {0, 1} <= classes:
        beta[len(features.names) : len(features.names) + 5], beta[-1] = [1, 2, 1, 1, 1], -4
    else:
        with batches_of(spark, ROW_BATCH):
            labels = LabelModel().fit(lambda measure: summed(counted.df, _voted, features, measure))
            for _ in range(25):
                sums = summed(counted.df, _slopes, features, labels, beta)
                beta, step = newton(sums[: size + 1], sums[size + 1 :].reshape(size + 1, -1), beta, RIDGE)
                if step < 1e-6:
                    break
        beta = np.round(beta, 8)  # sums over tasks differ in their last digits
    counted.drop()
    return beta


@tidy
def _scored(docs: DataFrame, labels: DataFrame, keys: list[str], fit_rows: int, most_stems: int) -> DataFrame:
    """``keys, score`` of documents ``doc_id, text`` and keys, each text read whole."""
    spark = docs.sparkSession
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    own = list(dict.fromkeys(["doc_id", *keys]))
    types = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in own)
    with batches_of(spark, TEXT_BATCH):
        features = voters(docs.select("doc_id", "text"), known, fit_rows, most_stems)
        shared = spark.sparkContext.broadcast(features)
        rows = Stage(docs.select(*own, "text").mapInArrow(_rows(shared), f"{types}, row binary"), "features").df
        model = spark.sparkContext.broadcast(fit(rows.select("doc_id", "row"), known, features))
        schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keys), "score double"])
    return rows.select(*keys, "row").mapInArrow(_scores(model), schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", most_stems: int = MOST_STEMS) -> DataFrame:
    """Score every document's whole text: ``doc_id, held_out, score, predicted``.

    Voters are a lexicon, patterns, and at most ``most_stems`` stems mined from at most ``fit_rows`` labelled rows outside the
    held-out third. The label model takes the votes of all documents outside that third, labelled or not; a label is a voter among the
    others, whose accuracy is estimated, so that enough voters overrule it. A linear classifier is fitted to the posterior
    labels and scores all documents. Labels and texts are the only inputs, labels of the fit alone.

    Null and empty texts get the score of a text without hits. Repeated rows get equal scores; a null id isn't held out. Without
    labels of both kinds, fixed weights of the lexicon's hits hold. An empty table gives no rows. Other columns aren't read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = _scored(plain, labels, ["doc_id"], fit_rows, most_stems)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, most_stems: int = MOST_STEMS) -> DataFrame:
    """The input's rows and columns without those that are predicted toxic; each row by its own text, whatever its id."""
    rows = sheltered(docs, "doc_id", "text")
    keyed = rows.withColumns({"_r0": F.xxhash64("doc_id", "text"), "_r1": F.xxhash64(F.lit(1), "doc_id", "text")})
    plain = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "_r0", "_r1", "text")
    toxic = _scored(plain, labels, ["_r0", "_r1"], fit_rows, most_stems).filter(F.col("score") >= CUT).select("_r0", "_r1").distinct()
    return keyed.join(toxic, ["_r0", "_r1"], "left_anti").select(rows.columns).toDF(*docs.columns)
