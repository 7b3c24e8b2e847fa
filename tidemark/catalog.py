"""The registered queries of the time-series engine, and the same in DuckDB SQL.

Events become points: metric = event type, or user and type; the fixed parameters are those of the flagship week.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions.aggregates import AGGREGATES, NAMES, aggregate
from .operators import admin, timeline as T
from .plans import archives as A
from .plans.rules import parse_rules, rule_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = 1706659200
LIST = [(600, 288), (3600, 168), (21600, 240)]
WEEK = NOW - 7 * 86400
XFF = 1
NODES = ["n0", "n1", "n2", "n3", "n4"]
RULES = parse_rules("""
[carts]
pattern = .*cart
xFilesFactor = 2
aggregationMethod = sum
retentions = 60s:2d,300s:7d
cacheRetention = 10m
metricsPerFile = 8
[first]
pattern = ^user\\.[0-4]
retentions = 10s:12h,60s:2d
metricsPerFile = 4
xFilesFactor = 20
aggregationMethod = max
cacheRetention = 620s
[rest]
pattern = user.*click
retentions = 60s:2d
metricsPerFile = 16
cacheRetention = 1h
""")


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``metric, ts, value, seq`` of all events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("metric"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), "value", F.col("event_id").alias("seq"))


def user_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ``user.<id>.<type>`` metrics."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.concat_ws(".", F.lit("user"), F.col("user_id").cast("string"), "event_type").alias("metric")).distinct()


def nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    name = lambda c: F.lower(F.replace(F.trim(c), F.lit(" "), F.lit("_")))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat_ws(".", name(F.col("r_name")), name(F.col("n_name"))).alias("metric"), F.col("n_nationkey").cast("bigint").alias("seq"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User metrics placed in files of eight, by shard and rule."""
    m = user_metrics(spark, sf_dir).select("metric", S.instance_of(F.col("metric"), 4).alias("instance"), rule_of(F.col("metric"), RULES).alias("schema"))
    return admin.allocate(m, 8, ["metric"])


EV = "ev AS (SELECT event_type AS metric, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts, value, event_id AS seq FROM events)"
L0 = f"{EV}, l0 AS (SELECT metric, ts // 600 * 600 AS slot_ts, arg_max(value, seq) AS value FROM ev GROUP BY ALL)"
SQL_AGG = {"average": "avg(value)", "sum": "sum(value)", "last": "arg_max(value, slot_ts)", "max": "max(value)", "min": "min(value)"}


def levels_sql(agg: str, xff: int = XFF) -> str:
    a, parts = SQL_AGG[agg], [L0]
    for i, (fine, low) in enumerate(((600, 3600), (3600, 21600)), 1):
        unit = S.propagation_unit(fine, low, xff)
        parts.append(f"l{i} AS (SELECT metric, slot_ts // {low} * {low} AS slot_ts, {a} AS value FROM l{i - 1} WHERE slot_ts < (SELECT max(slot_ts) // {unit} * {unit} FROM l{i - 1}) GROUP BY 1, 2)")
    return ", ".join(parts)


def levels(spark: SparkSession, sf_dir: str, agg: str, xff: float = XFF) -> list[DataFrame]:
    return T.cascade(T.slot_last_wins(events(spark, sf_dir), 600, ["seq"]), LIST, xff, agg)


USERS = "um AS (SELECT DISTINCT 'user.' || user_id || '.' || event_type AS metric FROM events)"
FNV = "CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END"
HASH = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(metric, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, i: (xor(h, i) * 16777619) & 4294967295)"
RULE_SQL = "CASE WHEN regexp_matches(metric, '^(?:.*cart)') THEN 'carts' WHEN regexp_matches(metric, '^(?:^user\\.[0-4])') THEN 'first' WHEN regexp_matches(metric, '^(?:user.*click)') THEN 'rest' ELSE 'default' END"
INDEX = f"{USERS}, hs AS (SELECT metric, {HASH} AS h FROM um), pl AS (SELECT metric, CAST(((({FNV}) % 4) + 4) % 4 AS INTEGER) AS instance, {RULE_SQL} AS schema FROM hs), nu AS (SELECT *, row_number() OVER (PARTITION BY instance, schema ORDER BY metric) - 1 AS nth FROM pl), ix AS (SELECT metric, instance, schema, CAST(nth // 8 AS INTEGER) AS file_id, CAST(nth % 8 AS INTEGER) AS pos FROM nu)"
NATIONS = "nn AS (SELECT lower(replace(trim(r_name), ' ', '_')) || '.' || lower(replace(trim(n_name), ' ', '_')) AS metric, CAST(n_nationkey AS BIGINT) AS seq FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {EV} SELECT metric, ts, value, seq, ts // 600 * 600 AS slot_ts FROM ev")
def slot_align(spark, sf_dir):
    return T.align(events(spark, sf_dir), 600)


@query(f"WITH {L0} SELECT * FROM l0")
def slot_last_wins(spark, sf_dir):
    return T.slot_last_wins(events(spark, sf_dir), 600, ["seq"])


@query(f"WITH {EV} SELECT metric, ts // 600 * 600 AS slot_ts, max(value) AS value FROM ev GROUP BY ALL")
def slot_max_wins(spark, sf_dir):
    return T.slot_max_wins(events(spark, sf_dir), 600)


@query("SELECT CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) // 86400 * 86400 AS slot_ts, max({'q': CAST(l_quantity AS DOUBLE), 'p': CAST(l_extendedprice AS DOUBLE)})['q'] AS quantity, max({'q': CAST(l_quantity AS DOUBLE), 'p': CAST(l_extendedprice AS DOUBLE)})['p'] AS price FROM lineitem GROUP BY 1")
def vector_max_wins(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = li.select(F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ts"), F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")).alias("vals"))
    return T.vector_max_wins(rows, 86400).select("slot_ts", F.col("vals")[0].alias("quantity"), F.col("vals")[1].alias("price"))


def _agg(name: str) -> None:
    def run(spark, sf_dir, name=name):
        slots = T.slot_last_wins(events(spark, sf_dir), 600, ["seq"])
        return T.downsample(slots, 3600, name).withColumn("value", F.round("value", 6))

    run.__name__ = f"agg_{name}"
    query(f"WITH {L0} SELECT metric, slot_ts // 3600 * 3600 AS slot_ts, round({SQL_AGG[name]}, 6) AS value FROM l0 GROUP BY 1, 2")(run)

    def two(spark, sf_dir, name=name):
        return levels(spark, sf_dir, name)[2].withColumn("value", F.round("value", 6))

    two.__name__ = f"cascade_two_level_{name}"
    query(f"WITH {levels_sql(name)} SELECT metric, slot_ts, round(value, 6) AS value FROM l2")(two)


for _name in NAMES:
    _agg(_name)


@query("SELECT * FROM (VALUES (0, 'average', 4.5), (1, 'sum', 45.0), (2, 'last', 9.0), (3, 'max', 9.0), (4, 'min', 0.0)) t(id, name, value)")
def aggregate_registry(spark, sf_dir):
    v = spark.range(10).select(F.col("id").cast("double").alias("value"), F.col("id").alias("slot_ts"))
    row = v.agg(*[aggregate(n, F.col("value"), F.col("slot_ts")).alias(n) for n in AGGREGATES])
    return row.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in NAMES]))).select(F.col("pos").alias("id"), "col.name", "col.value")


@query(f"WITH {L0}, u AS (SELECT max(slot_ts) // 7200 * 7200 AS upto FROM l0) SELECT metric, slot_ts, value FROM l0, u WHERE slot_ts < upto")
def complete_units_only(spark, sf_dir):
    return T.complete(T.slot_last_wins(events(spark, sf_dir), 600, ["seq"]), S.propagation_unit(600, 3600, 2))


@query(f"WITH {L0}, d AS (SELECT metric, slot_ts, value, length(metric) % 2 AS file FROM l0), u AS (SELECT file, max(slot_ts) // 7200 * 7200 AS upto FROM d GROUP BY 1) SELECT d.metric, d.slot_ts, d.value, CAST(d.file AS INTEGER) AS file FROM d JOIN u ON d.file = u.file WHERE slot_ts < upto")
def complete_units_per_file(spark, sf_dir):
    slots = T.slot_last_wins(events(spark, sf_dir), 600, ["seq"]).withColumn("file", F.length("metric") % 2)
    return T.complete(slots, 7200, ("file",)).select("metric", "slot_ts", "value", "file")


ROUTE = f"CASE WHEN {NOW} - ts <= 172800 THEN 0 WHEN {NOW} - ts <= 604800 THEN 1 WHEN {NOW} - ts <= 5184000 THEN 2 END"


@query(f"WITH {EV}, r AS (SELECT metric, ts, seq, {ROUTE} AS archive FROM ev) SELECT metric, ts, seq, archive, CAST([600, 3600, 21600][archive + 1] AS BIGINT) AS step FROM r WHERE archive IS NOT NULL")
def route_by_age(spark, sf_dir):
    return T.route(events(spark, sf_dir), LIST, NOW).drop("value")


@query(f"WITH {EV} SELECT * FROM ev WHERE {NOW} - ts > 604800")
def route_dropped(spark, sf_dir):
    return T.dropped(events(spark, sf_dir), LIST[:2], NOW)


@query(f"WITH {EV}, s AS (SELECT *, ts // 600 * 600 AS slot_ts, ts // 600 % 288 AS ring FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY metric, ring ORDER BY seq DESC, slot_ts DESC) AS n FROM s) SELECT metric, ring, ts, value, seq, slot_ts FROM r WHERE n = 1")
def ring_survivors(spark, sf_dir):
    return T.ring_survivors(T.align(events(spark, sf_dir), 600), 600, 288)


def _fetch(name: str, start: int, until: int | None, archive: int, agg: str) -> None:
    step = LIST[archive][0]
    low, high = S.roundup(start, step), S.roundup(min(until or NOW, NOW), step)

    def run(spark, sf_dir):
        own = levels(spark, sf_dir, agg)
        got = T.fetch(own, LIST, start, until, NOW, events(spark, sf_dir).select("metric").distinct())
        return got.withColumn("value", F.round("value", 6))

    run.__name__ = name
    query(f"WITH {levels_sql(agg)}, g AS (SELECT DISTINCT metric, unnest(range({low}, {high}, {step})) AS ts FROM (SELECT DISTINCT metric FROM ev)) SELECT g.metric, g.ts, CAST({step} AS BIGINT) AS step, round(l.value, 6) AS value FROM g LEFT JOIN l{archive} l ON g.metric = l.metric AND g.ts = l.slot_ts")(run)


_fetch("fetch_dense_finest", NOW - 86400 + 5, None, 0, "average")
_fetch("fetch_dense_hourly", WEEK, None, 1, "average")
_fetch("fetch_dense_coarse", NOW - 25 * 86400, NOW - 5 * 86400, 2, "max")
_fetch("fetch_clamped", NOW - 3 * 86400 + 7, NOW + 86400, 1, "sum")

ASKS = [0, 1, 172799, 172800, 172801, 604800, 604801, 5184000]


@query("SELECT a AS age, (SELECT min(i) FROM (VALUES (0, 172800), (1, 604800), (2, 5184000)) v(i, r) WHERE r >= a) AS archive FROM (SELECT unnest([" + ", ".join(map(str, ASKS)) + "]) AS a)")
def archive_select(spark, sf_dir):
    rows = [(a, A.plan_fetch(LIST, NOW - a, NOW + 1, NOW).archive) for a in ASKS]
    return spark.createDataFrame(rows, "age int, archive int")


@query(f"WITH {USERS}, hs AS (SELECT metric, {HASH} AS h FROM um) SELECT metric, {FNV} AS hash FROM hs")
def fnv1a_hash(spark, sf_dir):
    return user_metrics(spark, sf_dir).select("metric", S.fnv1a(F.col("metric")).alias("hash"))


@query(f"WITH {USERS}, hs AS (SELECT metric, {HASH} AS h FROM um) SELECT metric, CAST(((({FNV}) % 7) + 7) % 7 AS INTEGER) AS instance FROM hs")
def shard_instance(spark, sf_dir):
    return user_metrics(spark, sf_dir).select("metric", S.instance_of(F.col("metric"), 7).alias("instance"))


@query(f"WITH {NATIONS}, hs AS (SELECT metric, {HASH} AS h FROM nn), i AS (SELECT metric, ((({FNV}) % 5) + 5) % 5 AS k, ['n0','n1','n2','n3','n4'] AS l FROM hs) SELECT metric, l[k + 1] AS node, array_to_string(list_concat(l[k + 1 :], l[: k]), ',') AS nodes FROM i")
def hash_ring_rotate(spark, sf_dir):
    m = F.col("metric")
    return nation_names(spark, sf_dir).select("metric", S.ring_node(m, NODES).alias("node"), F.array_join(S.ring_nodes(m, NODES), ",").alias("nodes"))


@query(f"WITH {USERS} SELECT metric, {RULE_SQL} AS schema FROM um")
def schema_first_match(spark, sf_dir):
    return user_metrics(spark, sf_dir).select("metric", rule_of(F.col("metric"), RULES).alias("schema"))


@query(f"WITH {INDEX} SELECT * FROM ix")
def allocate_positions(spark, sf_dir):
    return index(spark, sf_dir)


@query(f"WITH {INDEX}, k AS (SELECT * FROM ix WHERE pos % 3 <> 1), w AS (SELECT metric, instance, schema, row_number() OVER (PARTITION BY instance, schema ORDER BY metric) AS nth FROM ix WHERE pos % 3 = 1 OR pos % 3 = 0), w2 AS (SELECT 'new.' || metric AS metric, instance, schema, nth FROM w), c AS (SELECT instance, schema, unnest(range(0, 2 * (SELECT count(*) FROM ix))) AS place FROM (SELECT DISTINCT instance, schema FROM ix)), f AS (SELECT c.*, row_number() OVER (PARTITION BY c.instance, c.schema ORDER BY place) AS nth FROM c LEFT JOIN k ON c.instance = k.instance AND c.schema = k.schema AND c.place = k.file_id * 8 + k.pos WHERE k.metric IS NULL) SELECT w2.metric, w2.instance, w2.schema, CAST(f.place // 8 AS INTEGER) AS file_id, CAST(f.place % 8 AS INTEGER) AS pos FROM w2 JOIN f ON w2.instance = f.instance AND w2.schema = f.schema AND w2.nth = f.nth")
def allocate_reuses_free(spark, sf_dir):
    ix = index(spark, sf_dir)
    new = ix.filter("pos % 3 <> 2").select(F.concat(F.lit("new."), "metric").alias("metric"), "instance", "schema")
    return admin.allocate_free(new, ix.filter("pos % 3 <> 1"), 8, ["metric"]).select("metric", "instance", "schema", "file_id", "pos")


@query(f"WITH {INDEX} SELECT metric, instance, schema, file_id, pos FROM ix")
def rebuild_index(spark, sf_dir):
    return admin.rebuild_index(admin.files_of(index(spark, sf_dir), 8))


@query(f"WITH {INDEX} SELECT metric, '/link/' || instance || '/' || replace(metric, '.', '/') || '.hs' AS link, '/data/' || instance || '/' || schema || '/' || file_id || '.hs' AS file FROM ix")
def rebuild_links(spark, sf_dir):
    return admin.links(index(spark, sf_dir), "/link", "/data")


@query(f"WITH {INDEX}, f AS (SELECT instance, schema, file_id FROM ix GROUP BY ALL HAVING count(*) FILTER (WHERE NOT regexp_matches(metric, 'click$')) = 0) SELECT * FROM f")
def empty_files(spark, sf_dir):
    ix = index(spark, sf_dir)
    kept = ix.withColumn("metric", F.when(F.col("metric").rlike("click$"), "").otherwise(F.col("metric")))
    return admin.empty_files(admin.files_of(kept, 8))


@query(f"WITH {EV}, b AS (SELECT metric, min(ts) AS start_ts, CAST(length(metric) * 86400 AS BIGINT) AS retention FROM ev GROUP BY 1) SELECT * FROM b WHERE {NOW - 20 * 86400} - start_ts - retention >= 10")
def buffers_due(spark, sf_dir):
    from .streaming.ingest import flushable

    b = events(spark, sf_dir).groupBy("metric").agg(F.min("ts").alias("start_ts")).withColumn("retention", (F.length("metric") * 86400).cast("bigint"))
    return flushable(b, NOW - 20 * 86400)


@query(f"WITH {L0} SELECT slot_ts AS ts, value FROM l0 WHERE metric = 'click' AND slot_ts < {NOW - 86400 + 300} // 600 * 600")
def hot_read(spark, sf_dir):
    from .streaming.ingest import hot_read as read

    return read(T.slot_last_wins(events(spark, sf_dir), 600, ["seq"]), "click", 600, NOW - 86400 + 300)


@query(f"WITH {INDEX}, c AS (SELECT instance, schema, file_id, 8 - count(*) AS free FROM ix GROUP BY ALL) SELECT instance, schema, file_id, CAST(free AS INTEGER) AS free FROM c")
def free_positions(spark, sf_dir):
    return admin.free_positions(admin.files_of(index(spark, sf_dir), 8))


@query(f"WITH {INDEX} SELECT instance AS bucket, schema, file_id AS fid, pos, metric FROM ix WHERE regexp_matches(metric, '^(?:(?:user\\.1)|(?:.*purchase))')")
def metric_regex_search(spark, sf_dir):
    return admin.search(index(spark, sf_dir), [r"user\.1", ".*purchase", "ser"][:2])


@query(f"WITH {INDEX}, g AS (SELECT DISTINCT instance, schema, file_id FROM ix EXCEPT SELECT instance, schema, file_id FROM ix WHERE regexp_matches(metric, '^(?:(?:user\\.[0-9]\\.)|(?:user\\.2))')), m AS (SELECT instance, schema, max(file_id) AS last FROM g GROUP BY ALL) SELECT g.instance, g.schema, g.file_id FROM g JOIN m USING (instance, schema) WHERE file_id < last")
def blacklist_files(spark, sf_dir):
    return admin.files_without(index(spark, sf_dir), [r"user\.[0-9]\.", r"user\.2"])


@query(f"WITH {INDEX} SELECT * FROM ix WHERE NOT regexp_matches(metric, 'click$')")
def delete_antijoin(spark, sf_dir):
    ix = index(spark, sf_dir)
    return admin.delete(ix, ix.filter(F.col("metric").rlike("click$")))[0]


@query(f"WITH {INDEX} SELECT instance, schema, file_id, pos, 'x.' || metric AS asked, metric AS held FROM ix WHERE pos = 0")
def delete_mismatches(spark, sf_dir):
    ix = index(spark, sf_dir)
    return admin.delete(ix, ix.filter("pos = 0").withColumn("metric", F.concat(F.lit("x."), "metric")))[1]


@query(f"WITH {INDEX} SELECT instance, schema, file_id, string_agg(metric, ',' ORDER BY metric) AS metrics FROM ix WHERE regexp_matches(metric, 'click$') GROUP BY ALL")
def delete_report(spark, sf_dir):
    return admin.delete_report(index(spark, sf_dir).filter(F.col("metric").rlike("click$"))).withColumn("metrics", F.array_join("metrics", ","))


@query(f"WITH {EV}, m AS (SELECT DISTINCT event_type AS metric FROM events) SELECT ts, max(CASE WHEN metric = 'click' THEN v END) AS click, max(CASE WHEN metric = 'view' THEN v END) AS view FROM (SELECT metric, ts // 60 * 60 AS ts, arg_max(value, seq) AS v FROM ev WHERE metric IN ('click', 'view') GROUP BY 1, 2) GROUP BY ts")
def merge_series(spark, sf_dir):
    return T.merge_series(events(spark, sf_dir).withColumn("ts", S.slot_floor(F.col("ts"), 60)), ["click", "view"])


@query(f"WITH {L0}, e AS (SELECT metric, min(slot_ts) AS lo, max(slot_ts) AS hi FROM l0 GROUP BY 1), g AS (SELECT metric, unnest(range(lo, least(hi, lo + 600 * 999) + 1, 600)) AS slot_ts FROM e) SELECT g.metric, g.slot_ts, l0.value FROM g LEFT JOIN l0 ON g.metric = l0.metric AND g.slot_ts = l0.slot_ts")
def fill_gaps(spark, sf_dir):
    return T.fill_gaps(T.slot_last_wins(events(spark, sf_dir), 600, ["seq"]), 600, 1000)


@query(f"WITH {L0}, g AS (SELECT metric, slot_ts, lag(slot_ts) OVER (PARTITION BY metric ORDER BY slot_ts) + 600 AS expected FROM l0) SELECT * FROM g WHERE slot_ts <> expected")
def gap_detect(spark, sf_dir):
    return T.gaps(T.slot_last_wins(events(spark, sf_dir), 600, ["seq"]), 600)


@query(f"WITH {L0}, g AS (SELECT metric, slot_ts, row_number() OVER (PARTITION BY metric ORDER BY slot_ts) - 1 AS p, lag(slot_ts) OVER (PARTITION BY metric ORDER BY slot_ts) + 600 AS expected FROM l0) SELECT metric, CAST(min(p) AS INTEGER) AS position FROM g WHERE slot_ts <> expected AND p > 10 GROUP BY 1")
def gap_first(spark, sf_dir):
    return T.first_gap(T.slot_last_wins(events(spark, sf_dir), 600, ["seq"]), 600, 10)


@query(f"WITH {L0}, g AS (SELECT metric, slot_ts, slot_ts - row_number() OVER (PARTITION BY metric ORDER BY slot_ts) * 600 AS island FROM l0) SELECT metric, min(slot_ts) AS start_ts, max(slot_ts) AS end_ts, count(*) AS points FROM g GROUP BY metric, island")
def runs(spark, sf_dir):
    return T.runs(T.slot_last_wins(events(spark, sf_dir), 600, ["seq"]), 600)


@query(f"WITH {L0}, g AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY slot_ts DESC) AS n FROM l0) SELECT metric, slot_ts, value, strftime(to_timestamp(slot_ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS shown FROM g WHERE n = 3")
def point_at(spark, sf_dir):
    got = T.point_at(T.slot_last_wins(events(spark, sf_dir), 600, ["seq"]), -3)
    return got.withColumn("shown", S.shown_time(F.col("slot_ts")))


@query(f"WITH {USERS} SELECT metric, CAST({NOW} AS BIGINT) AS ts, CAST(0 AS DOUBLE) AS value FROM (SELECT metric FROM um EXCEPT SELECT metric FROM um WHERE metric LIKE '%view%')")
def zero_fill_metrics(spark, sf_dir):
    m = user_metrics(spark, sf_dir)
    return admin.zero_fill(m, m.filter(F.contains("metric", F.lit("view"))), NOW)


TEXTS = ["90", "12h", "60s", "3 weeks", "2d", "5y", "1m", "7min", "x", "h", ""]


@query("SELECT * FROM (VALUES ('90', 90), ('12h', 43200), ('60s', 60), ('3 weeks', 1814400), ('2d', 172800), ('5y', 157680000), ('1m', 60), ('7min', 420), ('x', NULL), ('h', NULL), ('', NULL)) t(txt, seconds)")
def parse_durations(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in TEXTS], "txt string").select("txt", S.duration_seconds(F.col("txt")).cast("int").alias("seconds"))


@query("SELECT * FROM (VALUES ('60s:2d', 60, 2880), ('10:100', 10, 100), ('15m:25w', 900, 16800), ('12h:5y', 43200, 3650), ('7s:1m', 7, 8)) t(txt, step, points)")
def parse_retention(spark, sf_dir):
    t = spark.createDataFrame([(x,) for x in ("60s:2d", "10:100", "15m:25w", "12h:5y", "7s:1m")], "txt string")
    c = F.col("txt")
    return t.select("txt", S.retention_step(c).cast("int").alias("step"), S.retention_count(c).cast("int").alias("points"))


@query("WITH a AS (SELECT * FROM (VALUES ('good', 60, 10080), ('good', 300, 8640), ('indivisible', 180, 3360), ('indivisible', 300, 8640), ('coverage', 60, 1440), ('coverage', 300, 288), ('points', 60, 10), ('points', 3600, 24)) t(name, step, cnt)), n AS (SELECT *, lead(step) OVER w AS s2, lead(cnt) OVER w AS c2 FROM a WINDOW w AS (PARTITION BY name ORDER BY step)) SELECT name, CASE WHEN s2 % step <> 0 THEN 'indivisible' WHEN s2 * c2 <= step * cnt THEN 'coverage' WHEN cnt < s2 / step THEN 'points' ELSE '' END AS fault FROM n WHERE s2 IS NOT NULL")
def archive_validate(spark, sf_dir):
    lists = {"good": [(300, 8640), (60, 10080)], "indivisible": [(180, 3360), (300, 8640)], "coverage": [(60, 1440), (300, 288)], "points": [(60, 10), (3600, 24)]}
    return spark.createDataFrame([(n, ",".join(A.faults(x, 1))) for n, x in lists.items()], "name string, fault string")


@query("WITH a AS (SELECT * FROM (VALUES (0, 600, 288), (1, 3600, 168), (2, 21600, 240)) t(archive, step, count)), s AS (SELECT *, count * (4 + 8 * 5) AS size FROM a) SELECT archive, CAST(step AS BIGINT) AS step, CAST(count AS BIGINT) AS count, CAST(24 + 30 + 3 * 12 + coalesce(sum(size) OVER (ORDER BY archive ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, CAST(size AS BIGINT) AS size, CAST(step * count AS BIGINT) AS retention FROM s")
def archive_offsets(spark, sf_dir):
    return A.geometry(A.frame(spark, LIST), 30, 5)


@query("WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || ' ' || event_id WHEN 1 THEN '  ' || event_type || '  ' || event_id || '   ' || (event_id * 7) WHEN 2 THEN event_type || ' x ' || event_id WHEN 3 THEN event_type || ' 1 1.9' ELSE event_type || ' 2.5 ' || event_id END AS line, event_type FROM events) SELECT event_type AS metric, CAST(CASE event_id % 5 WHEN 1 THEN event_id * 7 ELSE event_id END AS BIGINT) AS ts, CAST(CASE event_id % 5 WHEN 1 THEN event_id ELSE 2.5 END AS DOUBLE) AS value FROM e WHERE event_id % 5 IN (1, 4)")
def line_parse(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.expr("CASE event_id % 5 WHEN 0 THEN event_type || ' ' || event_id WHEN 1 THEN '  ' || event_type || '  ' || event_id || '   ' || (event_id * 7) WHEN 2 THEN event_type || ' x ' || event_id WHEN 3 THEN event_type || ' 1 1.9' ELSE event_type || ' 2.5 ' || event_id END")
    from .sources.text import parse_lines

    return parse_lines(e.select(line.alias("value")))


@query(f"WITH {EV}, b AS (SELECT metric, min(ts) // 60 * 60 AS lo, max(ts) AS hi FROM ev GROUP BY 1) SELECT metric, ts, seq, CAST(value AS DOUBLE) AS value FROM ev WHERE value IS NOT NULL")
def batch_explode(spark, sf_dir):
    from .sources.text import explode_batches

    e = events(spark, sf_dir)
    points = e.select("seq", F.array(F.struct("metric", (F.col("ts") + F.lit(0.9)).cast("string").alias("ts"), F.col("value").cast("string").alias("value")), F.struct(F.col("metric"), F.lit("bad").alias("ts"), F.lit("1").alias("value"))).alias("points"))
    out = explode_batches(points.select(F.transform("points", lambda p: F.struct(F.concat_ws("#", p["metric"], F.col("seq").cast("string")).alias("metric"), p["ts"].alias("ts"), p["value"].alias("value"))).alias("points")))
    return out.select(F.split("metric", "#")[0].alias("metric"), "ts", F.split("metric", "#")[1].cast("bigint").alias("seq"), "value")


@query(f"WITH {EV}, c AS (SELECT metric, ts, seq, CAST(length(metric) % 3 AS INTEGER) AS instance FROM ev), n AS (SELECT *, ts // 3600 * 3600 AS hour FROM c), m AS (SELECT instance, metric, ts, seq, ts // 60 * 60 AS minute FROM n) SELECT instance, metric, ts, seq, minute, row_number() OVER (PARTITION BY instance, minute ORDER BY ts, seq) <= 1 AS admitted FROM m")
def create_rate_limit(spark, sf_dir):
    c = events(spark, sf_dir).select((F.length("metric") % 3).alias("instance"), "metric", "ts", "seq")
    return admin.admit(c, 1, ["seq"])


@query(f"WITH {EV}, s AS (SELECT seq % 2 AS instance, ts // 60 * 60 AS ts, metric, value FROM ev) SELECT 'tm.h_x.' || instance || '.' || n AS metric, ts, round(v, 6) AS value FROM (SELECT instance, ts, 'received' AS n, CAST(count(*) AS DOUBLE) AS v FROM s GROUP BY ALL UNION ALL SELECT instance, ts, 'largest', max(value) FROM s GROUP BY ALL UNION ALL SELECT instance, ts, 'meanValue', avg(value) FROM s GROUP BY ALL)")
def self_metrics_60s(spark, sf_dir):
    figures = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), v.alias("value")) for n, k, v in (("received", "incr", F.lit(1.0)), ("largest", "max", F.col("value")), ("meanValue", "append", F.col("value")))])
    e = events(spark, sf_dir).select((F.col("seq") % 2).alias("instance"), "ts", F.explode(figures).alias("f")).select("instance", "ts", "f.*")
    return admin.self_metrics(e, "tm", "h.x").withColumn("value", F.round("value", 6))


@query(f"WITH {L0}, p AS (SELECT metric, slot_ts, value FROM l0 WHERE {NOW} - slot_ts <= 5184000), n0 AS (SELECT metric, slot_ts // 1200 * 1200 AS slot_ts, arg_min(value, slot_ts) AS value FROM p WHERE {NOW} - slot_ts <= 1200 * 300 GROUP BY 1, 2), w1 AS (SELECT metric, slot_ts // 7200 * 7200 AS slot_ts, arg_min(value, slot_ts) AS value, 0 AS rank FROM p WHERE {NOW} - slot_ts > 1200 * 300 GROUP BY 1, 2), m1 AS (SELECT metric, slot_ts // 7200 * 7200 AS slot_ts, max(value) AS value, -1 AS rank FROM n0 WHERE slot_ts < (SELECT max(slot_ts) // 7200 * 7200 FROM n0) GROUP BY 1, 2), n1 AS (SELECT metric, slot_ts, arg_min(value, rank) AS value FROM (SELECT * FROM w1 UNION ALL SELECT * FROM m1) GROUP BY 1, 2) SELECT 0 AS archive, * FROM n0 UNION ALL SELECT 1, * FROM n1")
def alter_rebuild(spark, sf_dir):
    old = levels(spark, sf_dir, "max")[:1]
    rows = old[0].select(F.lit(0).alias("archive"), "metric", "slot_ts", "value")
    got = admin.rebuild(rows, LIST[:1], [(1200, 300), (7200, 720)], NOW, 1, "max")
    return got[0].select(F.lit(0).alias("archive"), "*").unionByName(got[1].select(F.lit(1).alias("archive"), "*"))


@query(f"WITH {EV}, a AS (SELECT metric, ts // 600 * 600 AS ts, arg_max(value, seq) AS value FROM ev GROUP BY 1, 2), h AS (SELECT metric, ts, value + 1 AS value FROM a WHERE ts >= {NOW - 5 * 86400}) SELECT metric, ts, coalesce(h.value, a.value) AS value FROM a LEFT JOIN h USING (metric, ts)")
def stitch_hot_points(spark, sf_dir):
    stored = T.slot_last_wins(events(spark, sf_dir), 600, ["seq"]).withColumnRenamed("slot_ts", "ts")
    hot = stored.filter(F.col("ts") >= NOW - 5 * 86400).withColumn("value", F.col("value") + 1)
    return T.stitch(stored, hot)


@query(f"WITH {INDEX}, p AS (SELECT 'user.' || user_id || '.' || event_type AS metric, event_id FROM events) SELECT p.metric, p.event_id, ix.instance, ix.schema, ix.file_id, ix.pos FROM p JOIN ix ON p.metric = ix.metric")
def locate_points(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    p = e.select(F.concat_ws(".", F.lit("user"), F.col("user_id").cast("string"), "event_type").alias("metric"), "event_id")
    return admin.locate(p, index(spark, sf_dir))


@query(f"WITH {NATIONS} SELECT metric, '/data/link/3/' || replace(metric, '.', '/') || '.hs' AS path, metric AS back, seq % 5 = 0 AS own, CASE WHEN seq % 5 = 0 THEN '/r/7/self/h/7/' || seq || '.hs' END AS remote FROM nn")
def metric_paths(spark, sf_dir):
    n = nation_names(spark, sf_dir)
    path = S.metric_path("/data/link/3", F.col("metric"))
    named = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("self.h.7."), F.col("seq").cast("string")))
    return n.select("metric", path.alias("path"), S.link_metric(path).alias("back"), (F.col("seq") % 5 == 0).alias("own"), F.when(named.isNotNull(), S.remote_path("/r", named, 4, "self.")).alias("remote"))


@query(f"WITH {INDEX} SELECT metric, instance, (h_own <> instance AND NOT starts_with(metric, 'user.1')) AS is_foreign FROM (SELECT metric, instance, (instance + 1) % 4 AS h_own FROM ix)")
def foreign_metrics(spark, sf_dir):
    ix = index(spark, sf_dir)
    return ix.select("metric", "instance", admin.foreign(F.col("metric"), (F.col("instance") + 1) % 4, 4, "user.1").alias("is_foreign"))


@query("SELECT * FROM (VALUES ('12', 'int'), ('-3', 'int'), ('1.5', 'float'), ('1e3', 'float'), ('abc', 'str'), ('', 'str')) t(txt, kind)")
def guess_types(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in ("12", "-3", "1.5", "1e3", "abc", "")], "txt string").select("txt", S.guessed_type(F.col("txt")).alias("kind"))


@query(f"WITH {EV} SELECT metric, ts, (ts + 599) // 600 * 600 AS up, ts // 600 * 600 AS down, ts // 600 % 288 AS ring FROM ev")
def slot_arithmetic(spark, sf_dir):
    ts = F.col("ts")
    return events(spark, sf_dir).select("metric", "ts", S.roundup_col(ts, 600).alias("up"), S.slot_floor(ts, 600).alias("down"), S.ring_slot(ts, 600, 288).alias("ring"))


@query("WITH o AS (SELECT o_orderpriority AS metric, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) // 86400 * 86400 AS slot_ts, arg_max(CAST(o_totalprice AS DOUBLE), o_orderkey) AS value FROM orders GROUP BY 1, 2) SELECT metric, slot_ts // 604800 * 604800 AS slot_ts, max(value) AS value FROM o WHERE slot_ts < (SELECT max(slot_ts) // 604800 * 604800 FROM o) GROUP BY 1, 2")
def orders_weekly_max(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("metric"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_totalprice").cast("double").alias("value"), F.col("o_orderkey").alias("seq"))
    return T.cascade(T.slot_last_wins(o, 86400, ["seq"]), [(86400, 3650), (604800, 1040)], 1, "max")[1]
