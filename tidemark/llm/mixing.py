"""Mixing sources to target weights by exact cuts of a random order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, WORD, Stage, null_key, sheltered, tidy

#: Rows that a bucket of a source's random order should have; there are as many hex digits of a bucket as that takes.
BUCKET_ROWS = 4096


def source_targets(totals: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Words for each source: its weight's share of all words, at most ``most`` times its own.

    ``totals`` has one row per source: ``source, skey, source_size``. What a source can't take
    goes to the others by weight until none is above its limit: in ascending order of limit per
    unit of weight, sources stay at their limit as long as it is no more than an equal share of
    what is left; the others share the rest. Exact in integers up to the last division.
    """
    big = "decimal(38,0)"
    lcm = math.lcm(*weights)
    order = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("long"))
    t = t.withColumn("ratio", (F.col("cap") * (F.lit(lcm) / F.col("weight")).cast("long")).cast("long"))
    before = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({
        "left_words": (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast(big),
        "left_weight": (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast(big),
    }).withColumn("full", F.col("cap").cast(big) * F.col("left_weight") <= F.col("weight").cast(big) * F.col("left_words"))
    rest = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = F.sum("source_size").over(rest) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(rest)
    share = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(rest)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * (words.cast("double") / share.cast("double")))
    return t.withColumn("target", target).select("skey", "source_size", "target")


@tidy
def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words the mix takes of each document.

    One row per input row: ``doc_id, size, source_size, target, taken``. Every source's documents
    stand in the order of a hash of their id, and the source's budget, its target rounded down,
    is cut from that order exactly: whole rounds first, then the documents up to the cut, of which
    the last gives only the words that are left. The order is split at fixed hash prefixes;
    prefix sums over these buckets and a running sum within each give every document's place, so
    that a hot source spreads over many tasks.

    Null texts have no words and take none; null ids and sources are a value of their own, and
    null comes last among sources. Repeated ids stand together, larger size last. An
    empty table gives no rows. Other columns aren't read.
    """
    return _plan(docs, weights, most, id_col, text_col, source_col, False)


def _plan(docs: DataFrame, weights: tuple[int, ...], most: int, id_col: str, text_col: str, source_col: str, carry: bool) -> DataFrame:
    row = [F.struct(*docs.columns).alias("_row")] if carry else []
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = Stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), null_key(F.col(source_col)).alias("skey"), size.alias("size"), key.alias("key"), *row), "sizes")
    rows, digits = sized.count(), 2
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    bucketed = sized.df.withColumn("bucket", F.substring("key", 1, digits))
    sums = Stage(bucketed.groupBy("skey", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size")), "buckets")
    targets = source_targets(sums.df.groupBy("skey").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size")), weights, most)
    upto = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.df.withColumn("start", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0))).drop("bucket_size", "source").join(targets, "skey")
    within = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size", *(["_row"] if carry else [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bucketed.withColumn("ahead", F.sum("size").over(within) - F.col("size")).join(starts, ["skey", "bucket"])
    rounds = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.floor("target").cast("long") - rounds * F.col("source_size") - F.col("start") - F.col("ahead")
    taken = rounds * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", *(["_row"] if carry else []))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mixed documents: each row as often as it is taken whole, then its first words if a part is left.

    Returns the input's columns; ``n_chars``, where there is one, follows the text. Null ids are taken like others, and repeated
    rows each as often as the plan says, since a row is carried through the plan, not joined to it.
    """
    rows = sheltered(docs, "doc_id", "text", "source", "n_chars")
    plan = _plan(rows, weights, most, "doc_id", "text", "source", True).filter("taken > 0").select("_row.*", F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    full, part = F.expr("cast(_taken div _size as int)"), F.expr("_taken % _size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), full), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    out = plan.withColumn("_words", F.explode(copies))
    lead = F.regexp_extract("text", rf"^(?:{BLANK})?", 0)
    words = F.slice(F.regexp_extract_all("text", F.lit(rf"{WORD}(?:{BLANK})?"), 0), 1, F.greatest("_words", F.lit(1)).cast("int"))
    cut = F.regexp_replace(F.concat(lead, F.array_join(words, "")), rf"(?:{BLANK})$", "")
    out = out.withColumn("text", F.when(F.col("_words") > 0, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_words") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(rows.columns).toDF(*docs.columns)
