"""Storage rules and daemon settings, read from INI text on the driver."""

from __future__ import annotations

import configparser
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import guessed, parse_duration, parse_retentions
from .archives import Archive, archives, faults

CACHE_RATIO = 1.2


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    archives: list[Archive]
    xff: float = 20.0
    agg: str = "average"
    cache_retention: int = 600
    metrics_per_file: int = 8
    cache_ratio: float = CACHE_RATIO
    faults: list[str] = field(default_factory=list)


#: What a metric that no rule matches gets.
FALLBACK = Rule("default", ".*", [Archive(60, 10080)], 20.0)


def _parser(text: str) -> configparser.ConfigParser:
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    parser.optionxform = str
    parser.read_string(text)
    return parser


def parse_rules(text: str) -> list[Rule]:
    """Rules in the order of the text; one with an invalid archive list is kept, with its faults."""
    found, parser = [], _parser(text)
    for name in parser.sections():
        s = parser[name]
        xff, list_ = float(s.get("xFilesFactor", 20)), archives(parse_retentions(s["retentions"]))
        found.append(Rule(name, s["pattern"], list_, xff, s.get("aggregationMethod", "average"), parse_duration(s.get("cacheRetention", "600s")), int(s.get("metricsPerFile", 8)), CACHE_RATIO, faults(list_, xff)))
    return found


def match(rules: list[Rule], metric: str, anchored: bool = True) -> Rule:
    """The first rule that matches, from the metric's start or, unanchored, anywhere."""
    find = re.match if anchored else re.search
    return next((r for r in rules if find(r.pattern, metric)), FALLBACK)


def rule_of(metric: Column, rules: list[Rule], anchored: bool = True) -> Column:
    """The name of the first matching rule: a chain of conditions, so no join."""
    chain = None
    for r in rules:
        hit = metric.rlike(f"^(?:{r.pattern})" if anchored else r.pattern)
        chain = F.when(hit, F.lit(r.name)) if chain is None else chain.when(hit, F.lit(r.name))
    return F.lit(FALLBACK.name) if chain is None else chain.otherwise(F.lit(FALLBACK.name))


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.name, r.pattern, r.xff, r.agg, [(a.step, a.count) for a in r.archives], r.cache_retention, r.metrics_per_file, r.cache_ratio) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "prio int, name string, pattern string, xff double, agg string, archives array<struct<step:bigint,count:bigint>>, cache_retention bigint, metrics_per_file int, cache_ratio double")


def parse_settings(text: str, section: str = "cache", instance: int | None = None) -> dict:
    """Values of ``[section]``, overridden by ``[section:instance]``, typed by their look."""
    parser = _parser(text)
    names = [section, *([f"{section}:{instance}"] if instance is not None else [])]
    return {k: guessed(v) for name in names if parser.has_section(name) for k, v in parser[name].items()}


def instances(text: str, section: str = "cache") -> list[int]:
    """The instances that a text configures; they must be 0..N-1, and as many as it says."""
    parser = _parser(text)
    ids = sorted(int(s.partition(":")[2]) for s in parser.sections() if s.startswith(f"{section}:"))
    said = parse_settings(text, section).get("NUM_ALL_INSTANCE", len(ids))
    if ids != list(range(len(ids))) or said != len(ids):
        raise ValueError(f"instances {ids} aren't 0..{said}-1")
    return ids


def legacy_schema(schemas: str, aggregations: str, metric: str) -> Rule:
    """The rule of two carbon-style files for a metric; patterns may match anywhere, the default is a minute for a week."""
    s = next((x for n, x in _parser(schemas).items() if "pattern" in x and re.search(x["pattern"], metric)), None)
    a = next((x for n, x in _parser(aggregations).items() if "pattern" in x and re.search(x["pattern"], metric)), None)
    list_ = archives(parse_retentions(s["retentions"])) if s else [Archive(60, 10080)]
    return Rule(s.name if s else "default", s["pattern"] if s else ".*", list_, float((a or {}).get("xFilesFactor", 0.5)), (a or {}).get("aggregationMethod", "average"))
