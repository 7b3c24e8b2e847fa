"""The corpus pipeline: five stages over documents, each on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import Stage, table
from tidemark.llm.lines import drop_repeated_lines
from tidemark.llm.mixing import mix
from tidemark.llm.near import drop_near_copies
from tidemark.llm.packing import pack
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that an earlier one holds."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share takes them; a source's last one is cut to its budget."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; each repeat of a document is packed."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Scores, hashes and tokens aren't in SQL's reach; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again by the next."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        done = Stage(stage(spark, docs, sf_dir), name)
        if last is not None:
            last.drop()
        docs, last = done.df, done
    return STAGES[-1][1](spark, docs, sf_dir)
