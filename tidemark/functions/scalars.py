"""Scalar functions: durations, slots, hashes, names and paths.

Each is a ``Column`` expression inside whole-stage codegen where rows need it; those that
configuration needs are plain Python as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The units of durations, by full name, in seconds.
UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800, "years": 31536000}

# FNV-1a, 32 bits.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619


class InvalidTime(ValueError):
    """A duration or a time range that can't be read."""


def parse_duration(text: str) -> int:
    """Seconds of ``90``, ``12h`` or ``3 weeks``; a unit may be any beginning of its name."""
    text = text.strip()
    digits = text[: len(text) - len(text.lstrip("0123456789"))]
    unit = text[len(digits) :].strip().lower()
    if not digits:
        raise InvalidTime(f"no number in {text!r}")
    if not unit:
        return int(digits)
    for name, seconds in UNITS.items():
        if name.startswith(unit):
            return int(digits) * seconds
    raise InvalidTime(f"unknown unit in {text!r}")


def parse_retention(text: str) -> tuple[int, int]:
    """(step, count) of ``60s:2d``; a bare number on the right is a count of points."""
    step_text, _, keep = text.strip().partition(":")
    step = parse_duration(step_text)
    return (step, int(keep)) if keep.strip().isdigit() else (step, parse_duration(keep) // step)


def parse_retentions(text: str) -> list[tuple[int, int]]:
    return [parse_retention(part) for part in text.split(",")]


def duration_seconds(text: Column) -> Column:
    """``parse_duration`` over a column; null where the text isn't a duration."""
    number = F.regexp_extract(text, r"^\s*(\d+)\s*([A-Za-z]*)\s*$", 1)
    unit = F.lower(F.regexp_extract(text, r"^\s*(\d+)\s*([A-Za-z]*)\s*$", 2))
    factor = F.when(unit == "", F.lit(1))
    for name, seconds in UNITS.items():
        factor = factor.when(F.startswith(F.lit(name), unit), F.lit(seconds))
    return F.when(number != "", number.try_cast("bigint") * factor.cast("bigint"))


def retention_step(text: Column) -> Column:
    return duration_seconds(F.split(text, ":")[0])


def retention_count(text: Column) -> Column:
    keep = F.split(text, ":")[1]
    return F.when(F.trim(keep).rlike(r"^\d+$"), F.trim(keep).try_cast("bigint")).otherwise(F.floor(duration_seconds(keep) / retention_step(text)).cast("bigint"))


def roundup(x: int, base: int) -> int:
    return -(-x // base) * base


def roundup_col(x: Column, base: Column | int) -> Column:
    base = F.lit(base) if isinstance(base, int) else base
    return slot_floor(x + base - 1, base)


def slot_floor(ts: Column, step: Column | int) -> Column:
    """The start of the slot that holds ``ts``; floors below zero too."""
    step = F.lit(step) if isinstance(step, int) else step
    return (ts - F.pmod(ts, step)).cast("bigint")


def ring_slot(ts: Column, step: Column | int, count: Column | int) -> Column:
    """A slot's place in a ring of ``count`` slots, wherever the ring starts."""
    step = F.lit(step) if isinstance(step, int) else step
    count = F.lit(count) if isinstance(count, int) else count
    return F.pmod(F.floor(ts / step).cast("bigint"), count)


def propagation_unit(high: int, low: int, xff: float) -> int:
    """Seconds that are downsampled at once: ``xff`` coarse slots, rounded up to whole fine ones."""
    return math.ceil(low / high * xff) * high


def fnv1a(key: Column) -> Column:
    """Signed 32-bit FNV-1a of a string's or binary's bytes, as long."""
    b = key.cast("binary")
    n = F.octet_length(b)
    places = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("bigint")
    h = F.aggregate(places, F.lit(FNV_OFFSET).cast("bigint"), lambda acc, i: acc.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME) % F.lit(1 << 32))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def fnv1a_py(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def instance_of(metric: Column, instances: int) -> Column:
    """The shard of a metric, never negative."""
    return F.pmod(fnv1a(metric), F.lit(instances)).cast("int")


def ring_node(key: Column, nodes: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, nodes)), instance_of(key, len(nodes)) + 1)


def ring_nodes(key: Column, nodes: list[str]) -> Column:
    """All nodes, from the key's own on."""
    every, at = F.array(*map(F.lit, nodes)), instance_of(key, len(nodes))
    return F.concat(F.slice(every, at + 1, F.lit(len(nodes))), F.slice(every, F.lit(1), at))


def metric_path(root: Column | str, metric: Column, suffix: str = ".hs") -> Column:
    """``a.b.c`` under ``root``; an absolute path stays as it is."""
    root = F.lit(root) if isinstance(root, str) else root
    return F.when(F.startswith(metric, F.lit("/")), metric).otherwise(F.concat(root, F.lit("/"), F.replace(metric, F.lit("."), F.lit("/")), F.lit(suffix)))


def data_path(root: str, instance: Column, schema: Column, file_id: Column, suffix: str = ".hs") -> Column:
    return F.concat(F.concat_ws("/", F.lit(root), instance.cast("string"), schema, file_id.cast("string")), F.lit(suffix))


def link_metric(path: Column, suffix: str = ".hs") -> Column:
    """The metric of a link path, ``…/link/<instance>/a/b/c.hs``; null for other paths."""
    inner = F.regexp_extract(path, rf"/link/[^/]+/(.+){suffix.replace('.', '[.]')}$", 1)
    return F.when(inner != "", F.replace(inner, F.lit("/"), F.lit(".")))


def remote_path(root: str, metric: Column, instances: int, self_prefix: str, suffix: str = ".hs") -> Column:
    """Where another node keeps a metric; self-metrics name their instance in their third part."""
    own = F.split(metric, "[.]")[2]
    instance = F.when(F.startswith(metric, F.lit(self_prefix)), own).otherwise(instance_of(metric, instances).cast("string"))
    return F.concat(F.concat_ws("/", F.lit(root), instance, F.replace(metric, F.lit("."), F.lit("/"))), F.lit(suffix))


def self_metric(prefix: str, host: Column, instance: Column, name: Column) -> Column:
    """Name of an engine's own metric; dots of the host become underscores, no instance is ``a``."""
    return F.concat_ws(".", F.lit(prefix), F.replace(host, F.lit("."), F.lit("_")), F.coalesce(instance.cast("string"), F.lit("a")), name)


def shown_time(ts: Column) -> Column:
    return F.coalesce(F.from_unixtime(ts), F.lit("invalid timestamp"))


def guessed(text: str) -> int | float | str:
    """A configuration value as int, else float, else as it stands."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def guessed_type(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), "int").when(text.try_cast("double").isNotNull(), "float").otherwise("str")


def flatten_deep(items) -> list:
    out: list = []
    for x in items:
        out += flatten_deep(x) if isinstance(x, (list, tuple)) else [x]
    return out


def cache_geometry(retention: int, resolution: int, ratio: float = 1.2) -> tuple[int, int]:
    """Points that a write buffer holds, and its slots with slack."""
    points = retention // resolution + 1
    return points, int(points * ratio)


def cache_slots(retention: Column, resolution: Column, ratio: float = 1.2) -> Column:
    """The same for columns: ``points, slots``."""
    points = F.floor(retention / resolution).cast("bigint") + 1
    return F.struct(points.alias("points"), F.floor(points * F.lit(ratio)).cast("bigint").alias("slots"))


def flatten_all(nested: Column, depth: int) -> Column:
    """An array nested ``depth`` times below its outermost level, as one array."""
    for _ in range(depth):
        nested = F.flatten(nested)
    return nested


def taken_bits(positions: Column) -> Column:
    """A bit map of taken positions, up to 63: the bitwise or of a group's."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), positions.cast("int")))


def first_free(bits: Column) -> Column:
    """The lowest position whose bit isn't set."""
    inverse = F.bitwise_not(bits)
    return F.bit_count(inverse.bitwiseAND(-inverse) - 1).cast("int")
