"""The five aggregates and their registry; an aggregate's id is its place in the list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of (value, slot): nulls never count, and no values give null.
AGGREGATES: dict[str, Callable[[Column, Column], Column]] = {
    "average": lambda value, ts: F.avg(value),
    "sum": lambda value, ts: F.sum(value),
    "last": lambda value, ts: F.max_by(value, F.when(value.isNotNull(), ts)),
    "max": lambda value, ts: F.max(value),
    "min": lambda value, ts: F.min(value),
}
NAMES = list(AGGREGATES)


def aggregate_id(name: str) -> int:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}")
    return NAMES.index(name)


def aggregate_name(id_: int) -> str:
    return NAMES[id_]


def aggregate(name: str, value: Column, ts: Column) -> Column:
    aggregate_id(name)
    return AGGREGATES[name](value, ts)
