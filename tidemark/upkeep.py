"""Registered queries of the store, of files' life and of the text sources, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import EV, INDEX, LIST, NOW, RULES, SQL_AGG, USERS, events, index, query, user_metrics
from .functions import scalars as S
from .operators import series, timeline as T
from .plans import archives as A
from .plans.rules import Rule, legacy_schema, rules_frame
from .sources import text
from .sources.shared import shared_dir
from .sources.store import Store

RULE = Rule("events", ".*", A.archives(LIST), 1)


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares."""
    return f"{shared_dir(spark)}/tidemark/store-{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf_dir: str, now: int | None = None, rule: Rule = RULE) -> tuple[Store, DataFrame]:
    """A store with the events of even and then, in a second write, of odd number."""
    store, e = Store(spark, scratch(spark), [rule]), events(spark, sf_dir)
    for n in (0, 1):
        store.append(e.filter(F.col("seq") % 2 == n), n, now)
    return store, e


WRITES = f"{EV}, w AS (SELECT metric, ts, value, seq, {{'w': seq % 2, 's': seq}} AS o FROM ev), k AS (SELECT metric, ts // 600 * 600 AS slot_ts, arg_max(value, o) AS value FROM w GROUP BY 1, 2)"


@query(f"WITH {WRITES}, f AS (SELECT metric, ts // 600 * 600 AS slot_ts, arg_max(value, o) AS value FROM w WHERE {NOW} - ts <= 172800 GROUP BY 1, 2), g AS (SELECT unnest(['click', 'view', 'nothing']) AS metric, unnest(range({S.roundup(NOW - 86400, 600)}, {NOW}, 600)) AS ts), g2 AS (SELECT m.metric, t.ts FROM (SELECT unnest(['click', 'view', 'nothing']) AS metric) m, (SELECT unnest(range({S.roundup(NOW - 86400, 600)}, {S.roundup(NOW, 600)}, 600)) AS ts) t) SELECT g2.metric, g2.ts, CAST(600 AS BIGINT) AS step, f.value FROM g2 LEFT JOIN f ON g2.metric = f.metric AND g2.ts = f.slot_ts".replace(f", g AS (SELECT unnest(['click', 'view', 'nothing']) AS metric, unnest(range({S.roundup(NOW - 86400, 600)}, {NOW}, 600)) AS ts)", ""))
def store_fetch(spark, sf_dir):
    return stored(spark, sf_dir, NOW)[0].fetch("events", ["click", "view", "nothing"], NOW - 86400, None, NOW)


def _routed(i: int) -> str:
    (step, count), before = LIST[i], LIST[i - 1][0] * LIST[i - 1][1] if i else -(10**12)
    return f"SELECT {i} AS archive, metric, ts // {step} * {step} AS slot_ts, arg_max(value, o) AS value FROM w WHERE {NOW} - ts <= {step * count} AND {NOW} - ts > {before} GROUP BY 1, 2, 3"


@query(f"WITH {WRITES} " + " UNION ALL ".join(_routed(i) for i in range(3)))
def store_routes(spark, sf_dir):
    store = stored(spark, sf_dir, NOW)[0]
    parts = [store.level("events", i).select(F.lit(i).alias("archive"), "*") for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {WRITES}, l1 AS (SELECT metric, slot_ts // 3600 * 3600 AS slot_ts, avg(value) AS value FROM k WHERE slot_ts < (SELECT max(slot_ts) // 3600 * 3600 FROM k) GROUP BY 1, 2), l2 AS (SELECT metric, slot_ts // 21600 * 21600 AS slot_ts, avg(value) AS value FROM l1 WHERE slot_ts < (SELECT max(slot_ts) // 21600 * 21600 FROM l1) GROUP BY 1, 2) SELECT metric, slot_ts, round(value, 6) AS value FROM l2")
def store_settle(spark, sf_dir):
    store, e = Store(spark, scratch(spark), [RULE]), events(spark, sf_dir)
    for n in (0, 1):
        part = e.filter(F.col("seq") % 2 == n)
        store.append(part, n)
        store.settle("events", n, store.touched(part)["events"])
    return store.level("events", 2).withColumn("value", F.round("value", 6))


@query(f"WITH {WRITES} SELECT * FROM k WHERE slot_ts > {NOW - 172800}")
def store_retention(spark, sf_dir):
    store = stored(spark, sf_dir)[0]
    store.expire(NOW)
    return store.held("events", 0, NOW)


@query(f"WITH {WRITES}, again AS (SELECT metric, ts // 600 * 600 AS slot_ts, arg_max(value, seq) AS value FROM ev WHERE metric = 'click' AND seq % 10 = 0 GROUP BY 1, 2) SELECT * FROM k WHERE metric <> 'click' UNION ALL SELECT * FROM again")
def store_delete(spark, sf_dir):
    store, e = stored(spark, sf_dir)
    store.delete(spark.createDataFrame([("click",)], "metric string"), 1)
    store.append(e.filter("metric = 'click' and seq % 10 = 0"), 2)
    return store.level("events", 0)


FILES = f"{INDEX}, fp AS (SELECT instance, schema, file_id, list_transform(range(8), lambda p: coalesce(map_from_entries(list({{'k': pos, 'v': metric}}))[p], '')) AS tags FROM ix WHERE NOT metric LIKE '%click' GROUP BY ALL)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.admin import files_of

    return files_of(index(spark, sf_dir).filter("not metric like '%click'"), 8)


@query(f"WITH {FILES} SELECT instance, schema, file_id, 'max' AS agg, CAST(2 AS DOUBLE) AS xff, CAST(5184000 AS BIGINT) AS max_retention, CAST(len(list_filter(tags, lambda t: t = '')) * 96 AS INTEGER) AS reserved_size, array_to_string(tags, ',') AS tags FROM fp")
def create_series(spark, sf_dir):
    f = files(spark, sf_dir)
    known = series.metadata(f.filter("file_id = 0"), LIST, 2, "max")
    add, there = series.created(f, known)
    return known.unionByName(series.metadata(add.join(there, ["instance", "schema", "file_id"], "left_anti"), LIST, 2, "max")).drop("archives").withColumn("tags", F.array_join("tags", ","))


@query(f"WITH {FILES}, s AS (SELECT *, CAST(list_position(tags, '') - 1 AS INTEGER) AS p, len(list_filter(tags, lambda t: t = '')) * 3 AS room FROM fp), n AS (SELECT *, CASE WHEN p IS NOT NULL AND p >= 0 THEN 'new.' || file_id END AS tag FROM s) SELECT instance, schema, file_id, array_to_string(list_transform(range(8), lambda i: CASE WHEN i = p AND tag IS NOT NULL THEN tag ELSE tags[i + 1] END), ',') AS tags, CAST(CASE WHEN tag IS NULL THEN room ELSE greatest(room - len(tag), 0) END AS INTEGER) AS reserved_size, CASE WHEN tag IS NULL THEN true ELSE room >= len(tag) END AS in_place FROM n")
def add_tag(spark, sf_dir):
    f = files(spark, sf_dir)
    meta = series.metadata(f, LIST, 2, "max").withColumn("reserved_size", F.size(F.filter("tags", lambda t: t == "")) * 3)
    free = f.withColumn("pos", series.tag_position(F.col("tags"), F.lit("")).cast("int")).filter("pos is not null")
    out = series.add_tags(meta, free.select("instance", "schema", "file_id", "pos", F.concat(F.lit("new."), F.col("file_id").cast("string")).alias("metric")))
    return out.select("instance", "schema", "file_id", F.array_join("tags", ",").alias("tags"), "reserved_size", "in_place")


@query(f"WITH {FILES} SELECT instance, schema, file_id, CASE WHEN schema = 'rest' THEN 'sum' ELSE 'max' END AS agg, CAST(CASE WHEN schema = 'rest' THEN 5 ELSE 2 END AS DOUBLE) AS xff FROM fp")
def change_meta(spark, sf_dir):
    return series.change_meta(series.metadata(files(spark, sf_dir), LIST, 2, "max"), "rest", 5, "sum").select("instance", "schema", "file_id", "agg", "xff")


@query(f"WITH {INDEX} SELECT metric, CAST(pos AS BIGINT) AS at FROM ix WHERE metric NOT LIKE '%click' UNION ALL SELECT metric, NULL FROM ix WHERE metric LIKE '%click'")
def tag_position(spark, sf_dir):
    ix = index(spark, sf_dir).select("metric", "instance", "schema", "file_id")
    return ix.join(files(spark, sf_dir), ["instance", "schema", "file_id"], "left").select("metric", series.tag_position(F.col("tags"), F.col("metric")).cast("bigint").alias("at"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey), ',') AS keys, array_to_string(list(o_orderpriority ORDER BY o_orderkey), ',') AS priorities FROM orders GROUP BY 1")
def transpose(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", F.array(F.col("o_orderkey").cast("string"), "o_orderpriority").alias("row"))
    rows = o.groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "row"))), lambda x: x["row"]).alias("rows"))
    columns = rows.select("day", series.transpose(F.col("rows")).alias("c"))
    return columns.select("day", F.array_join(F.col("c")[0], ",").alias("keys"), F.array_join(F.col("c")[1], ",").alias("priorities"))


BUFFER = f"{EV}, b AS (SELECT CAST(length(metric) % 2 AS INTEGER) AS file, CAST(seq % 3 AS INTEGER) AS pos, ts // 3600 * 3600 AS slot_ts, value, seq FROM ev WHERE ts >= {NOW - 5 * 86400}), c AS (SELECT file, pos, slot_ts, arg_max(value, seq) AS value FROM b GROUP BY 1, 2, 3)"


def buffer(spark: SparkSession, sf_dir: str):
    e = events(spark, sf_dir).filter(F.col("ts") >= NOW - 5 * 86400)
    rows = e.select((F.length("metric") % 2).cast("int").alias("file"), (F.col("seq") % 3).cast("int").alias("pos"), "ts", "value", "seq")
    bounds = rows.select("file").distinct().select("file", F.lit((NOW - 5 * 86400) // 3600 * 3600).cast("bigint").alias("start_ts"), F.lit(3).alias("width"))
    return series.flushed(rows, bounds, NOW - 86400, 3600)


STOP = (NOW - 86400) // 3600 * 3600


@query(f"WITH {BUFFER}, g AS (SELECT file, unnest(range({(NOW - 5 * 86400) // 3600 * 3600}, {STOP}, 3600)) AS slot_ts FROM (SELECT DISTINCT file FROM b)) SELECT g.file, g.slot_ts, max(CASE WHEN pos = 0 THEN value END) AS v0, max(CASE WHEN pos = 1 THEN value END) AS v1, max(CASE WHEN pos = 2 THEN value END) AS v2 FROM g LEFT JOIN c ON g.file = c.file AND g.slot_ts = c.slot_ts GROUP BY 1, 2")
def buffer_flush(spark, sf_dir):
    return buffer(spark, sf_dir)[0].select("file", "slot_ts", *[F.get("vals", F.lit(i)).alias(f"v{i}") for i in range(3)])


@query(f"WITH {BUFFER} SELECT file, pos, slot_ts, value FROM c WHERE slot_ts >= {STOP}")
def buffer_stays(spark, sf_dir):
    return buffer(spark, sf_dir)[1]


@query(f"WITH {BUFFER} SELECT file, CASE WHEN max(slot_ts) >= {STOP} THEN CAST({STOP} AS BIGINT) END AS start_ts FROM c GROUP BY 1")
def buffer_starts(spark, sf_dir):
    return buffer(spark, sf_dir)[2]


@query(f"WITH {EV}, p AS (SELECT 0 AS archive, metric, ts // 600 * 600 AS ts, value, seq FROM ev WHERE metric IN ('click', 'view') UNION ALL SELECT 1, metric, ts // 3600 * 3600, value, seq FROM ev WHERE metric IN ('click', 'view')), m AS (SELECT archive, ts, arg_max(value, seq) FILTER (WHERE metric = 'click') AS click, arg_max(value, seq) FILTER (WHERE metric = 'view') AS view FROM p GROUP BY 1, 2), e AS (SELECT archive, min(ts) AS lo, max(ts) AS hi, CASE archive WHEN 0 THEN 600 ELSE 3600 END AS step, CASE archive WHEN 0 THEN 288 ELSE 168 END AS n FROM m GROUP BY 1), g AS (SELECT archive, unnest(range(lo, least(hi, lo + step * (n - 1)) + 1, step)) AS ts FROM e) SELECT CAST(g.archive AS INTEGER) AS archive, g.ts, click, view FROM g LEFT JOIN m ON g.archive = m.archive AND g.ts = m.ts")
def merge_write(spark, sf_dir):
    e = events(spark, sf_dir)
    levels = [e.select(F.lit(i).alias("archive"), "metric", S.slot_floor(F.col("ts"), step).alias("ts"), "value", "seq") for i, (step, _) in enumerate(LIST[:2])]
    path = scratch(spark)
    series.write_merged(levels[0].unionByName(levels[1]), ["click", "view"], LIST[:2], path)
    return spark.read.parquet(path).select("archive", "ts", F.get("vals", F.lit(0)).alias("click"), F.get("vals", F.lit(1)).alias("view"))


@query(f"WITH {FILES}, r AS (SELECT instance, schema, file_id, unnest(range(0, 1800, 600)) AS ts FROM fp) SELECT ix.metric, r.ts, CAST(r.ts + ix.pos AS DOUBLE) AS value FROM ix JOIN r USING (instance, schema, file_id) WHERE ix.metric LIKE '%view'")
def file_column_pick(spark, sf_dir):
    f = files(spark, sf_dir)
    rows = f.select("instance", "schema", "file_id", F.explode(F.sequence(*[F.lit(x).cast("bigint") for x in (0, 1200, 600)])).alias("ts")).withColumn("vals", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("ts") + i).cast("double")))
    wanted = index(spark, sf_dir).filter("metric like '%view'").select("metric", "instance", "schema", "file_id")
    return series.pick_column(rows, f, wanted)


@query(f"WITH {INDEX} SELECT metric, schema, file_id, pos FROM ix WHERE instance < 2")
def index_round_trip(spark, sf_dir):
    path, ix = scratch(spark), index(spark, sf_dir)
    for i in (0, 1):
        text.write_index(ix.filter(F.col("instance") == i), f"{path}/{i}")
    return text.read_index(spark, f"{path}/0").unionByName(text.read_index(spark, f"{path}/1"))


@query(f"WITH {USERS} SELECT metric AS line FROM um")
def list_file(spark, sf_dir):
    path = scratch(spark)
    user_metrics(spark, sf_dir).select(F.explode(F.array(F.concat(F.lit("  "), "metric"), F.concat(F.lit("# "), "metric"), F.lit(""))).alias("value")).write.text(path)
    return text.read_list(spark, path)


@query(f"WITH {INDEX} SELECT DISTINCT CAST(instance AS VARCHAR) AS instance, schema, file_id FROM ix")
def files_by_path(spark, sf_dir):
    from .operators.admin import links

    return links(index(spark, sf_dir), "/link", "/data").select(text.place(F.col("file")).alias("place")).select("place.*").distinct()


@query(f"WITH {EV} SELECT ts, value FROM ev WHERE metric = 'click' AND ts >= {NOW - 86400}")
def fetch_tsv(spark, sf_dir):
    path = scratch(spark)
    text.write_tsv(events(spark, sf_dir).filter((F.col("metric") == "click") & (F.col("ts") >= NOW - 86400)), path)
    return spark.read.schema("ts bigint, value double").option("sep", "\t").csv(path)


@query(f"WITH {EV} SELECT metric, ts, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, seq DESC) AS nth FROM ev")
def newest_first(spark, sf_dir):
    from pyspark.sql import Window

    return T.latest_first(events(spark, sf_dir)).select("metric", "ts", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("ts"), F.desc("seq"))).cast("bigint").alias("nth"))


@query("SELECT * FROM (VALUES (0, 'carts', CAST(2 AS DOUBLE), 'sum', CAST(600 AS BIGINT), 8), (1, 'first', 20, 'max', 620, 4), (2, 'rest', 20, 'average', 3600, 16)) t(prio, name, xff, agg, cache_retention, metrics_per_file)")
def storage_rules(spark, sf_dir):
    return rules_frame(spark, RULES).select("prio", "name", "xff", "agg", "cache_retention", "metrics_per_file")


@query("SELECT * FROM (VALUES ('a.count.x', 'counts', 10, 'sum', CAST(0.0 AS DOUBLE)), ('b.min', 'default', 60, 'min', 0.1), ('c', 'default', 60, 'average', 0.5)) t(metric, name, step, agg, xff)")
def legacy_rules(spark, sf_dir):
    schemas, aggregations = "[counts]\npattern = count\nretentions = 10s:1d", "[min]\npattern = \\.min$\nxFilesFactor = 0.1\naggregationMethod = min\n[sum]\npattern = count\nxFilesFactor = 0\naggregationMethod = sum"
    found = [(m, legacy_schema(schemas, aggregations, m)) for m in ("a.count.x", "b.min", "c")]
    return spark.createDataFrame([(m, r.name, r.archives[0].step, r.agg, r.xff) for m, r in found], "metric string, name string, step int, agg string, xff double")


@query("SELECT * FROM (VALUES ('same', 'none'), ('factor', 'meta'), ('aggregate', 'meta'), ('longer', 'rebuild')) t(name, change)")
def alter_schema(spark, sf_dir):
    old = {"archives": LIST, "agg": "max", "xff": 2}
    new = {"same": {}, "factor": {"xff": 3}, "aggregate": {"agg": "min"}, "longer": {"archives": [*LIST[:2], (21600, 480)]}}
    return spark.createDataFrame([(n, A.schema_change(old, old | c)) for n, c in new.items()], "name string, change string")


@query(f"WITH {EV}, m AS (SELECT metric, ts // 86400 * 86400 AS ts, {SQL_AGG['sum']} AS value FROM ev GROUP BY 1, 2) SELECT metric, ts, round(value, 6) AS value FROM m WHERE ts > {NOW} - 86400 * 10")
def recent_slots(spark, sf_dir):
    from .sources.packed import recent

    days = T.downsample(events(spark, sf_dir).withColumnRenamed("ts", "slot_ts"), 86400, "sum").withColumns({"step": F.lit(86400), "count": F.lit(10)})
    return recent(days, NOW).select("metric", F.col("slot_ts").alias("ts"), F.round("value", 6).alias("value"))


STATS = f"{EV}, st AS (SELECT seq % 2 AS instance, ts // 3600 * 3600 AS ts, CASE metric WHEN 'click' THEN 'updateTimes' WHEN 'view' THEN 'committedPoints' WHEN 'purchase' THEN 'cpuUsage' ELSE 'creates' END AS name, value FROM ev), fi AS (SELECT instance, ts, CAST(count(value) FILTER (WHERE name = 'updateTimes') AS DOUBLE) AS n, avg(value) FILTER (WHERE name = 'updateTimes') AS a, sum(value) FILTER (WHERE name = 'committedPoints') AS c, max(value) FILTER (WHERE name = 'cpuUsage') AS u, sum(value) FILTER (WHERE name = 'creates') AS w FROM st GROUP BY ALL)"


@query(f"WITH {STATS}, l AS (SELECT instance, ts, unnest(['updateOperations', 'avgUpdateTime', 'committedPoints', 'creates', 'cpuUsage', 'pointsPerUpdate', 'droppedCreates', 'errors', 'cacheQueries', 'cacheOverflow', 'metricReceived']) AS f, unnest([n, a, coalesce(c, 0), coalesce(w, 0), u, CASE WHEN c > 0 AND n > 0 THEN c / n END, 0, 0, 0, 0, 0]) AS v FROM fi) SELECT 'tm.h_x.' || instance || '.' || f AS metric, ts, round(v, 6) AS value FROM l WHERE v IS NOT NULL")
def operator_metrics(spark, sf_dir):
    from .operators import admin

    name = F.when(F.col("metric") == "click", "updateTimes").when(F.col("metric") == "view", "committedPoints").when(F.col("metric") == "purchase", "cpuUsage").otherwise("creates")
    stats = events(spark, sf_dir).select((F.col("seq") % 2).alias("instance"), "ts", name.alias("name"), "value")
    return admin.operator_metrics(stats, "tm", "h.x", 3600).withColumn("value", F.round("value", 6))


@query(f"WITH {INDEX}, b AS (SELECT instance, schema, file_id, bit_or(1::BIGINT << pos) AS bits FROM ix WHERE pos <> 2 GROUP BY ALL) SELECT instance, schema, file_id, bits, CAST((SELECT min(p) FROM range(64) t(p) WHERE (bits >> p) & 1 = 0) AS INTEGER) AS free FROM b")
def position_bits(spark, sf_dir):
    taken = index(spark, sf_dir).filter("pos <> 2").groupBy("instance", "schema", "file_id").agg(S.taken_bits(F.col("pos")).alias("bits"))
    return taken.withColumn("free", S.first_free(F.col("bits")))


@query("SELECT name, CAST(cache_retention // step + 1 AS BIGINT) AS points, CAST(floor((cache_retention // step + 1) * 1.2) AS BIGINT) AS slots FROM (VALUES ('carts', 600, 60), ('first', 620, 10), ('rest', 3600, 60)) t(name, cache_retention, step)")
def buffer_geometry(spark, sf_dir):
    rules = rules_frame(spark, RULES).select("name", S.cache_slots(F.col("cache_retention"), F.col("archives")[0]["step"]).alias("g"))
    return rules.select("name", F.col("g.points").alias("points"), F.col("g.slots").alias("slots"))


@query("SELECT o_orderpriority AS priority, array_to_string(list(CAST(k AS VARCHAR) ORDER BY k), ',') AS keys FROM (SELECT o_orderpriority, o_orderkey AS k FROM orders WHERE o_orderkey % 100 = 0) GROUP BY 1")
def flatten_lists(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey % 100 = 0")
    nested = o.groupBy(F.col("o_orderpriority").alias("priority"), (F.col("o_orderkey") % 7).alias("p")).agg(F.array(F.collect_list("o_orderkey")).alias("own")).groupBy("priority").agg(F.collect_list("own").alias("nested"))
    return nested.select("priority", F.array_join(F.transform(F.array_sort(S.flatten_all(F.col("nested"), 2)), lambda k: k.cast("string")), ",").alias("keys"))


@query("SELECT * FROM (VALUES ('whole week', CAST(604800 AS BIGINT)), ('three levels', 5184000)) t(name, seconds)")
def max_retention(spark, sf_dir):
    return spark.createDataFrame([("whole week", A.max_retention([(60, 10080)])), ("three levels", A.max_retention(LIST))], "name string, seconds bigint")


@query("SELECT * FROM (VALUES (0, 'NUM_ALL_INSTANCE', '2', 'int'), (0, 'PORT', '2004', 'int'), (0, 'RATE', '0.5', 'float'), (1, 'NUM_ALL_INSTANCE', '2', 'int'), (1, 'PORT', '2003', 'int'), (1, 'RATE', '0.5', 'float')) t(instance, name, value, kind)")
def daemon_settings(spark, sf_dir):
    from .plans.rules import instances, parse_settings

    config = "[cache]\nNUM_ALL_INSTANCE = 2\nPORT = 2003\nRATE = 0.5\n[cache:0]\nPORT = 2004\n[cache:1]\n"
    rows = [(i, k, str(v), type(v).__name__) for i in instances(config) for k, v in parse_settings(config, instance=i).items()]
    return spark.createDataFrame(rows, "instance int, name string, value string, kind string")


@query("SELECT * FROM (VALUES (1, 0, 100, CAST(0 AS BIGINT), CAST(60 AS BIGINT)), (2, 30, 50, NULL, NULL), (3, 0, 50, -60, 0), (4, 130, 250, 120, 240)) t(id, start, until, low, high)")
def propagation_spans(spark, sf_dir):
    from .operators.updates import propagation_range

    asks = [(1, 0, 100), (2, 30, 50), (3, 0, 50), (4, 130, 250)]
    return spark.createDataFrame([(i, a, b, *(propagation_range(a, b, 10, 60, 1) or (None, None))) for i, a, b in asks], "id int, start int, until int, low bigint, high bigint")


PACKED = [("a.b", 0, 10, 1.0), ("a.b", 0, 11, None), ("c", 0, 10, 2.0), ("c", 0, 11, 3.0)]


def packed_folder(spark: SparkSession) -> str:
    """A folder with one packed file of two metrics, written through Spark's file systems."""
    from .sources import packed

    path = scratch(spark)
    data = packed.pack_header(["a.b", "c"], [(1, 2)], 1.0, "max", 5) + packed.pack_points([(10, [1.0, 2.0]), (11, [None, 3.0])])
    hadoop = spark._jvm.org.apache.hadoop.fs
    to = hadoop.Path(f"{path}/0.hs")
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to)
    out.write(bytearray(data))
    out.close()
    return path


@query("SELECT * FROM (VALUES ('a.b', CAST(10 AS BIGINT), CAST(1 AS DOUBLE)), ('a.b', 11, NULL), ('c', 10, 2), ('c', 11, 3)) t(metric, slot_ts, value)")
def packed_points(spark, sf_dir):
    from .sources import packed

    return packed.points(spark, packed_folder(spark)).select("metric", "slot_ts", "value")


@query("SELECT * FROM (VALUES ('max', CAST(2 AS BIGINT), CAST(1 AS DOUBLE), 'a.b,c', 5, 20, CAST(1 AS BIGINT), CAST(40 AS BIGINT))) t(agg, max_retention, xff, tags, reserved_size, point_size, step, size)")
def packed_header(spark, sf_dir):
    from .sources import packed

    h = packed.headers(spark, packed_folder(spark))
    return h.select("agg", "max_retention", "xff", F.array_join("tags", ",").alias("tags"), "reserved_size", "point_size", F.col("archives")[0]["step"].alias("step"), F.col("archives")[0]["size"].alias("size"))


@query("SELECT * FROM (VALUES (0, CAST(7200 AS BIGINT), CAST(5 AS DOUBLE)), (0, 7260, 9), (0, 10860, 7), (1, 7200, 9)) t(archive, slot_ts, value)")
def file_update(spark, sf_dir):
    from .operators.updates import File

    f = File(spark, ["m"], [(60, 600), (3600, 240)], 1, "max")
    for rows, now in (([(7201, [1.0]), (7205, [5.0]), (7265, [9.0])], 7300), ([(10865, [7.0])], 10900)):
        f.update(spark.createDataFrame(rows, "ts bigint, vals array<double>"), now, 7300)
    return f.state.filter("value is not null").select("archive", "slot_ts", "value")


@query(f"WITH {EV}, b AS (SELECT metric, ts // 600 * 600 AS slot_ts, arg_max(value, seq) AS value FROM ev GROUP BY 1, 2) SELECT metric, slot_ts AS ts, value FROM b WHERE metric IN ('click', 'view') AND slot_ts < {NOW - 86400} // 600 * 600")
def query_answers(spark, sf_dir):
    from .streaming.ingest import answers

    asked = spark.createDataFrame([(" click ",), ("view",), ("nothing",)], "value string")
    return answers(asked, T.slot_last_wins(events(spark, sf_dir), 600, ["seq"]), 600, NOW - 86400)
