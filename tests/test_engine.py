import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.aggregates import NAMES, aggregate_id
from tidemark.operators import timeline as T
from tidemark.plans import archives as A
from tidemark.plans import rules as R
from tidemark.sources import packed, text
from tidemark.sources.store import Store
from tidemark.streaming import ingest as I

LIST = [(1, 60), (3, 60), (6, 60)]
INI = """
[metric-test]
pattern = .*metric_test.*
xFilesFactor = 1
aggregationMethod = average
retentions = 1s:1h,6s:2h
cacheRetention = 10s
metricsPerFile = 8
[default]
pattern = .*
retentions = 10s:12h,60s:2d
xFilesFactor = 20
aggregationMethod = average
metricsPerFile = 8
cacheRetention = 620s
"""


def points(spark, rows):
    return spark.createDataFrame([(m, t, v, i) for i, (m, t, v) in enumerate(rows)], "metric string, ts bigint, value double, seq bigint")


def test_scalars(spark):
    assert S.parse_duration("12h") == 43200 and S.parse_retention("60s:2d") == (60, 2880) and S.parse_retention("7s:1m") == (7, 8)
    for bad in ("", "h", "5 parsecs"):
        with pytest.raises(S.InvalidTime):
            S.parse_duration(bad)
    assert [S.roundup(x, 10) for x in (21, 20, 19)] == [30, 20, 20]
    assert [S.propagation_unit(1, 3, x) for x in (5, 1, 0.5)] == [15, 3, 2]
    assert S.flatten_deep([1, (2, 3, [4]), 5]) == [1, 2, 3, 4, 5] and S.cache_geometry(600, 10) == (61, 73)
    keys = [b"", b"a", b"foobar", b"hello", bytes([0xFF, 0, 0, 1])]
    want = [0x811C9DC5, 0xE40C292C, 0xBF9CF968, 0x4F9F2CAB, 0xC48FB86D]
    assert [S.fnv1a_py(k) & 0xFFFFFFFF for k in keys] == want
    got = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary").select(S.fnv1a(F.col("k")).alias("h")).collect()
    assert [r.h & 0xFFFFFFFF for r in got] == want and all(-(2**31) <= r.h < 2**31 for r in got)
    assert NAMES == ["average", "sum", "last", "max", "min"] and aggregate_id("min") == 4
    with pytest.raises(ValueError):
        aggregate_id("avg")


def test_rules():
    rules = R.parse_rules(INI)
    assert R.match(rules, "system.loadavg.min_1.metric_test").name == "metric-test" and R.match(rules, "x").name == "default"
    assert [a.retention for a in rules[0].archives] == [3600, 7200] and rules[1].cache_retention == 620
    ab = [R.Rule("ab", "ab", [A.Archive(1, 1)])]
    assert R.match(ab, "xab").name == "default" and R.match(ab, "xab", anchored=False).name == "ab"
    conf = "[cache]\nA = 1\nB = x\nNUM_ALL_INSTANCE = 2\n[cache:0]\nA = 2.5\n[cache:1]\n"
    assert R.parse_settings(conf, instance=0) == {"A": 2.5, "B": "x", "NUM_ALL_INSTANCE": 2} and R.instances(conf) == [0, 1]
    with pytest.raises(ValueError):
        R.instances(conf.replace("= 2\n", "= 3\n"))
    assert R.legacy_schema("[s]\npattern = cpu\nretentions = 10s:1d\n", "[g]\npattern = .*\nxFilesFactor = 0.2\naggregationMethod = max\n", "sys.cpu").agg == "max"
    assert A.faults([(180, 3360), (300, 8640)], 1) == ["indivisible"] and not A.faults([(60, 10080), (300, 8640)], 1)
    with pytest.raises(A.InvalidArchives):
        A.validated([], 1)
    meta = {"agg": "min", "xff": 1, "archives": [(1, 2)]}
    assert [A.schema_change(meta, meta | x) for x in ({}, {"xff": 2}, {"agg": "max"}, {"archives": [(1, 3)]})] == ["none", "meta", "meta", "rebuild"]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 500), st.integers(1, 500))
def test_plan_is_dense_and_inside(age, span):
    now = 1_000_000
    r = A.plan_fetch(LIST, now - age, now - age + span, now)
    if r is None:
        assert now - age + span < now - 360
    else:
        assert r.start % r.step == r.until % r.step == 0 and r.until - r.start <= span + r.step
        assert r.step == next((s for s, n in LIST if s * n >= min(age, 360)), 6)


def test_routing_is_a_partition(spark):
    rng = random.Random(1)
    rows = [("m", 1000 - rng.randint(-20, 500), float(i)) for i in range(400)] + [("m", 1000 - 60, 1.0), ("m", 1000 - 61, 1.0), ("m", 1000 - 360, 1.0), ("m", 1000 - 361, 1.0)]
    p = points(spark, rows)
    routed, dropped = T.route(p, LIST, 1000).collect(), T.dropped(p, LIST, 1000).collect()
    assert len(routed) + len(dropped) == len(rows)
    for r in routed:
        assert r.archive == next(i for i, (s, n) in enumerate(LIST) if s * n >= 1000 - r.ts)
    ring = T.ring_survivors(T.align(p, 3), 3, 60).collect()
    assert len(ring) <= 60


@pytest.mark.parametrize("agg", ["min", "max", "sum", "last"])
def test_cascade_equals_recomputation(spark, agg):
    rng = random.Random(2)
    rows = [(f"m{rng.randint(0, 2)}", rng.randint(0, 300), float(rng.randint(0, 50))) for _ in range(500)]
    l0 = T.slot_last_wins(points(spark, rows), 1, ["ts", "seq"])
    levels = T.cascade(l0, LIST, 2, agg)
    upto = 0
    for unit, source in zip(A.units(LIST, 2), levels):
        upto = source.agg(F.max("slot_ts")).first()[0] // unit * unit
    direct = T.downsample(l0.filter(F.col("slot_ts") < upto), 6, agg)
    assert sorted(direct.collect()) == sorted(levels[2].collect())


def test_sparse_series(spark):
    s = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 2.0), ("a", 50, 3.0), ("b", 0, None)], "metric string, slot_ts bigint, value double")
    filled = sorted((r.metric, r.slot_ts, r.value) for r in T.fill_gaps(s, 10, 4).collect())
    assert filled == [("a", 10, 1.0), ("a", 20, 2.0), ("a", 30, None), ("a", 40, None), ("b", 0, None)]
    assert [tuple(r) for r in T.gaps(s, 10).collect()] == [("a", 50, 30)]
    assert sorted(tuple(r) for r in T.runs(s, 10).collect()) == [("a", 10, 20, 2), ("a", 50, 50, 1), ("b", 0, 0, 1)]
    assert T.dense(s, s.select("metric").distinct(), A.Range(0, 10, 20, 20)).count() == 0
    base = 1421830000
    m = points(spark, [("x", base + 133, 0.0), ("x", base + 134, 1.0), ("x", base + 135, 2.0), ("y", base + 134, 4.0), ("y", base + 135, 5.0), ("z", base + 133, 6.0), ("z", base + 134, 7.0), ("z", base + 135, 8.0)])
    got = [(r.ts - base, r.vals) for r in T.merge_vectors(m, ["x", "y", "z"]).orderBy("ts").collect()]
    assert got == [(133, [0, None, 6]), (134, [1, 4, 7]), (135, [2, 5, 8])]


def test_text_sources(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in ("m 1.5 10", " m  2 11 ", "a b", "m x 1", "m 1 1.9", "m nan 3", "m 1 2 3")], "value string")
    assert sorted(tuple(r) for r in text.parse_lines(lines).collect()) == [("m", 10, 1.5), ("m", 11, 2.0)]
    assert text.malformed_lines(lines).count() == 4
    (tmp_path / "index").write_text("a s 0 1\nbad line\nb s 0 2\n")
    assert text.read_index(spark, str(tmp_path / "index")).count() == 2
    (tmp_path / "index").write_text("a s 0 1\nbad line\nworse\n")
    with pytest.raises(ValueError):
        text.read_index(spark, str(tmp_path / "index"))
    (tmp_path / "list").write_text("# no\n\n x \ny\n")
    assert sorted(r.line for r in text.read_list(spark, str(tmp_path / "list")).collect()) == ["x", "y"]
    assert text.generate(spark, ["a", "b"], 0, 10, 3).count() == 6


def test_packed_files(spark, tmp_path):
    tags, list_ = ["a.b", "", "c"], [(1, 3), (3, 2)]
    head = packed.pack_header(tags, list_, 0.5, "max", reserved=4)
    body = packed.pack_points([(10, [1.0, None, 2.0]), (0, [0.0, 0.0, 0.0]), (11, [None, None, 3.0]), (9, [1.0, None, 3.0]), (0, [0.0] * 3)])
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "0.hs").write_bytes(head + body)
    h = packed.headers(spark, str(tmp_path / "many")).first()
    assert (h.agg, h.max_retention, h.xff, h.tags, h.reserved_size, h.point_size) == ("max", 6, 0.5, tags, 4, 28)
    assert [a.offset for a in h.archives] == [len(head), len(head) + 84]
    got = sorted((r.metric, r.archive, r.slot_ts, r.value is None) for r in packed.points(spark, str(tmp_path / "many")).collect())
    assert got == [("a.b", 0, 10, False), ("a.b", 0, 11, True), ("a.b", 1, 9, False), ("c", 0, 10, False), ("c", 0, 11, False), ("c", 1, 9, False)]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "x.wsp").write_bytes(struct.pack(">2LfL3L", 3, 20, 0.5, 1, 28, 10, 2) + struct.pack(">LdLd", 100, 4.0, 0, 0.0))
    r = packed.recent(packed.points(spark, str(tmp_path / "one"), many=False), 110).collect()
    assert [(x.agg, x.slot_ts, x.value) for x in r] == [("last", 100, 4.0)]
    assert packed.recent(packed.points(spark, str(tmp_path / "one"), many=False), 120).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rules = R.parse_rules("[t]\npattern = t\nretentions = 1s:5m,3s:10m\nxFilesFactor = 1\naggregationMethod = sum\n")
    rng = random.Random(4)
    lines = [f"t{rng.randint(0, 1)} {i} {1000 + i // 2}" for i in range(200)] + ["junk", "other 1 1000"]
    (tmp_path / "in").mkdir()
    seen = []

    def failing(batch, n):
        raise RuntimeError("ignored")

    store = Store(spark, str(tmp_path / "s"), rules)
    for part in range(2):
        (tmp_path / "in" / f"{part}.txt").write_text("\n".join(lines[part * 101 : (part + 1) * 101]))
        q = I.ingest(I.file_lines(spark, str(tmp_path / "in")), store, str(tmp_path / "c"), handlers=(failing, lambda b, n: seen.append(b.count())))
        q.awaitTermination(120)
    assert sum(seen) == 201
    p = text.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).filter("metric <> 'other'").withColumn("seq", F.col("value").cast("bigint"))
    want = T.cascade(T.slot_last_wins(p, 1, ["ts", "seq"]), [(1, 300), (3, 200)], 1, "sum")
    for i in (0, 1):
        assert sorted(store.level("t", i).collect()) == sorted(want[i].collect())
    metrics = spark.createDataFrame([("t0",), ("t1",)], "metric string")
    assert store.fetch("t", metrics, 1000, 1100, 1100).count() == 200
    assert store.fetch("t", metrics, 1000 - 400, 1100, 1100).filter("step = 3").count() > 0


def test_token_bucket(spark, tmp_path):
    b = I.TokenBucket(60, 1, 0)
    assert b.take(6, 0) and b.take(54, 0) and not b.take(1, 0) and b.take(1, 1)
    (tmp_path / "c").mkdir()
    spark.createDataFrame([(i % 2, 100, f"m{i:02d}") for i in range(12)], "instance int, ts bigint, metric string").write.mode("overwrite").parquet(str(tmp_path / "c"))
    s = I.admitted(spark.readStream.schema("instance int, ts bigint, metric string").parquet(str(tmp_path / "c")), 4)
    q = s.writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select instance, sum(cast(admitted as int)) n from admitted group by 1").collect()
    assert {r.instance: r.n for r in got} == {0: 4, 1: 4}
