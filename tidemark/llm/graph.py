"""Distributed union-find over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, join_by_group


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Every node's larger neighbours move to the smallest node next to it."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    return join_by_group(both.filter("v > u"), least, "u", "n", 2 * total).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of these."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    met = join_by_group(links, least, "a", "n", total)
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _trace(links: DataFrame) -> tuple[int, int, int]:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return row[0], row[1], row[2]


def components(links: DataFrame) -> DataFrame:
    """The smallest node of each node's component: ``node, root``, one row per node that has a link to a smaller one.

    ``links`` has long columns ``a`` and ``b``; order, repeats and loops don't matter. Stars
    are contracted to and fro until nothing changes; each round is written to the shared
    folder, so that a lost executor costs one round at most.
    """
    ordered = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = Stage(ordered, "links")
    trace = _trace(now.df)
    while trace[0]:
        large = Stage(_large_star(now.df, trace[0]), "links")
        now.drop()
        now = Stage(_small_star(large.df, trace[0]), "links")
        large.drop()
        last, trace = trace, _trace(now.df)
        if trace == last:
            break
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
