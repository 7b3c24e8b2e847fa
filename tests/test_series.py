import glob
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.plans.archives import archives
from tidemark.plans.rules import Rule
from tidemark.sources import packed
from tidemark.sources.store import Store
from tidemark.streaming import ingest as I

POINTS = "metric string, ts bigint, value double, seq bigint"
RULE = Rule("r", ".*", archives([(1, 300), (10, 300)]), 10, "sum")


def points(spark, rows):
    return spark.createDataFrame(rows, POINTS)


def values(df):
    return sorted((r.metric, r.slot_ts, r.value) for r in df.collect())


def test_create_refuses_what_is_there(spark):
    files = spark.createDataFrame([(0, "r", 0, ["a", ""]), (0, "r", 1, ["b", "c"])], "instance int, schema string, file_id int, tags array<string>")
    known = series.metadata(files.filter("file_id = 0"), [(1, 300), (10, 300)], 10, "sum")
    assert [(r.reserved_size, r.max_retention, len(r.archives)) for r in known.collect()] == [(96, 3000, 2)]
    with pytest.raises(series.SeriesExists):
        series.create_series(files, known, [(1, 300)], 10, "sum")
    assert series.create_series(files.filter("file_id = 1"), known, [(1, 300)], 10, "sum").count() == 2


def test_tags_in_place_and_anew(spark):
    meta = spark.createDataFrame([(0, "r", 0, ["a", ""], 3), (0, "r", 1, ["", ""], 1), (0, "r", 2, ["x"], 0)], "instance int, schema string, file_id int, tags array<string>, reserved_size int")
    tags = spark.createDataFrame([(0, "r", 0, 1, "bc"), (0, "r", 1, 0, "long")], "instance int, schema string, file_id int, pos int, metric string")
    got = {r.file_id: (r.tags, r.reserved_size, r.in_place) for r in series.add_tags(meta, tags).collect()}
    assert got == {0: (["a", "bc"], 1, True), 1: (["long", ""], 0, False), 2: (["x"], 0, True)}


def test_transpose_and_positions(spark):
    row = spark.createDataFrame([([[1, 2], [3, 4], [5, 6]], ["a", "b"])], "m array<array<int>>, tags array<string>")
    got = row.select(series.transpose(F.col("m")).alias("t"), series.tag_position(F.col("tags"), F.lit("b")).alias("at"), series.tag_position(F.col("tags"), F.lit("z")).alias("no"), series.transpose(F.filter("m", lambda r: F.lit(False))).alias("none")).first()
    assert (got.t, got.at, got.no, got.none) == ([[1, 3, 5], [2, 4, 6]], 1, None, [])


def test_flush_is_dense_and_starts_anew(spark):
    rows = spark.createDataFrame([("f", 0, 11, 1.0, 1), ("f", 0, 12, 2.0, 0), ("f", 1, 31, 3.0, 2), ("g", 0, 10, 4.0, 3)], "file string, pos int, ts bigint, value double, seq bigint")
    bounds = spark.createDataFrame([("f", 10, 2), ("g", 10, 1)], "file string, start_ts bigint, width int")
    out, stays, starts = series.flushed(rows, bounds, 35, 10)
    assert sorted((r.file, r.slot_ts, r.vals) for r in out.collect()) == [("f", 10, [1.0, None]), ("f", 20, [None, None]), ("g", 10, [4.0]), ("g", 20, [None])]
    assert [(r.file, r.pos, r.slot_ts, r.value) for r in stays.collect()] == [("f", 1, 30, 3.0)]
    assert {r.file: r.start_ts for r in starts.collect()} == {"f": 30, "g": None}


def test_last_arrival_wins_though_it_is_older(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), [RULE])
    store.append(points(spark, [("a", 5, 1.0, 2), ("a", 5, 2.0, 1)]), 0)
    assert values(store.level("r", 0)) == [("a", 5, 1.0)]
    store.append(points(spark, [("a", 5, 3.0, 0)]), 1)
    store.append(points(spark, [("a", 5, 3.0, 0)]), 1)  # once more
    assert values(store.level("r", 0)) == [("a", 5, 3.0)]


def test_routing_retention_and_expiry(spark, tmp_path):
    now = 10 * 86400
    store = Store(spark, str(tmp_path / "s"), [RULE])
    store.append(points(spark, [("a", now - 300, 1.0, 0), ("a", now - 301, 2.0, 1), ("a", now - 3001, 3.0, 2), ("a", now + 5, 4.0, 3)]), 0, now)
    assert values(store.level("r", 0)) == [("a", now - 300, 1.0), ("a", now + 5, 4.0)]
    assert values(store.level("r", 1)) == [("a", (now - 301) // 10 * 10, 2.0)]
    assert values(store.held("r", 0, now)) == [("a", now + 5, 4.0)]
    assert store.expire(now) == 0 and store.expire(now + 86400 + 299) == 2
    assert values(store.level("r", 0)) == [("a", now + 5, 4.0)]


def test_a_file_completes_only_its_own_units(spark, tmp_path):
    index = spark.createDataFrame([("a", 0, "r", 0), ("b", 0, "r", 0), ("c", 0, "r", 1)], "metric string, instance int, schema string, file_id int")
    store = Store(spark, str(tmp_path / "s"), [RULE], index)
    unit = 100  # ten slots of the finer archive times the factor
    store.append(points(spark, [("a", 7, 1.0, 0), ("b", unit + 1, 1.0, 1), ("c", 7, 5.0, 2)]), 0)
    store.settle("r", 0)
    assert values(store.level("r", 1)) == [("a", 0, 1.0)]
    store.append(points(spark, [("c", unit + 50, 2.0, 0), ("a", 8, 4.0, 1)]), 1)
    store.settle("r", 1, since=8)
    assert values(store.level("r", 1)) == [("a", 0, 5.0), ("c", 0, 5.0)]
    store.append(points(spark, [("c", 5 * unit, 2.0, 0)]), 2)
    store.settle("r", 2, since=5 * unit)  # what the file hasn't settled is before that
    assert values(store.level("r", 1)) == [("a", 0, 5.0), ("c", 0, 5.0), ("c", unit + 50, 2.0)]


def test_deletion_and_later_writes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), [RULE])
    store.append(points(spark, [("a", 1, 1.0, 0), ("b", 1, 1.0, 1)]), 0)
    store.delete(spark.createDataFrame([("a",)], "metric string"), 0)
    assert values(store.level("r", 0)) == [("b", 1, 1.0)]
    store.append(points(spark, [("a", 2, 7.0, 0)]), 1)
    assert values(store.level("r", 0)) == [("a", 2, 7.0), ("b", 1, 1.0)]


def test_few_files_and_pushed_filters(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), [RULE], spread=4)
    store.append(points(spark, [(f"m{i % 50}", i // 50, 1.0, i) for i in range(5000)]), 0)
    assert len(glob.glob(os.path.join(tmp_path, "s/points/*/*/*/*.parquet"))) <= 4
    plan = store.fetch("r", ["m1", "m2"], 20, 100, 100)._jdf.queryExecution().executedPlan().toString()
    assert "In(metric, [m1,m2])" in plan and "slot_ts" in plan.split("PushedFilters")[1] and "PartitionFilters" in plan
    got = store.fetch("r", ["m1", "m2"], 20, 100, 100)
    assert got.count() == 160 and got.filter("value is null").count() == 0


def test_columns_of_packed_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    body = packed.pack_points([(10, [1.0, 2.0]), (11, [3.0, None])])
    (tmp_path / "f/0.hs").write_bytes(packed.pack_header(["a", "b"], [(1, 2)], 1.0, "sum") + body)
    got = packed.points(spark, str(tmp_path / "f"), metrics=["b"]).collect()
    assert [(r.metric, r.slot_ts, r.value) for r in got] == [("b", 10, 2.0), ("b", 11, None)]


def test_buffer_stream_keeps_the_last_arrival(spark, tmp_path):
    (tmp_path / "in").mkdir()
    points(spark, [("a", 5, 1.0, 2), ("a", 5, 2.0, 1), ("a", 5000, 9.0, 3)]).write.mode("append").parquet(str(tmp_path / "in"))
    q = I.buffered(spark.readStream.schema(POINTS).parquet(str(tmp_path / "in")), 10, 60).writeStream.format("memory").queryName("buffered").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.metric, r.slot_ts, r.value) for r in spark.table("buffered").collect()] == [("a", 0, 1.0)]
    assert I.socket_lines(spark, "localhost", None) is None


def test_upkeep_queries_equal_their_sql(spark):
    import duckdb

    from tidemark import catalog, upkeep

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        db.sql(f"create view {os.path.basename(path).partition('.')[0]} as select * from '{path}'")
    names = [n for n in catalog.ORACLES if getattr(getattr(upkeep, n, None), "__module__", "") == "tidemark.upkeep"]
    assert len(names) > 20
    for name in names:
        got, want = catalog.QUERIES[name](spark, sf), db.sql(catalog.ORACLES[name])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        at = [want.columns.index(c) for c in cols]
        plain = lambda rows: sorted(str([float(v) if isinstance(v, int) else v for v in r]) for r in rows)
        assert plain([r[c] for c in cols] for r in got.collect()) == plain([r[i] for i in at] for r in want.fetchall()), name


def serve(lines):
    """A socket that sends some lines to whoever connects."""
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))

    def run():
        while True:
            try:
                conn, _ = server.accept()
            except OSError:
                return
            conn.sendall("".join(x + "\n" for x in lines).encode())

    threading.Thread(target=run, daemon=True).start()
    return server, server.getsockname()[1]


@pytest.mark.parametrize("kind", ["lines", "batches", "queries"])
def test_listeners(spark, kind):
    buffer = spark.createDataFrame([("a.b", 0, 1.0), ("a.b", 60, 2.0)], "metric string, slot_ts bigint, value double")
    server, port = serve({"lines": ["a.b 1.5 7", "junk"], "batches": ['{"points": [{"metric": "a.b", "ts": "7.9", "value": "1.5"}, {"metric": "x", "ts": "y", "value": "1"}]}'], "queries": ["a.b"]}[kind])
    stream = {"lines": I.socket_lines, "batches": I.socket_batches}[kind](spark, "127.0.0.1", port) if kind != "queries" else I.socket_queries(spark, "127.0.0.1", port, buffer, 60, 65)
    q = stream.writeStream.format("memory").queryName(f"heard_{kind}").outputMode("append").start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            got = [(r.metric, r.ts, r.value) for r in spark.table(f"heard_{kind}").collect()]
            if got:
                break
    finally:
        q.stop()
        server.close()
    assert got == [("a.b", 0, 1.0)] if kind == "queries" else got == [("a.b", 7, 1.5)]


def test_rate_points_and_generated_load(spark):
    from tidemark.sources import text

    q = text.rate_points(spark, ["a", "b"], 50).writeStream.format("memory").queryName("rates").start()
    try:
        for _ in range(40):
            q.processAllAvailable()
            if spark.table("rates").count() > 5:
                break
    finally:
        q.stop()
    assert {r.metric for r in spark.table("rates").collect()} == {"a", "b"}
    assert text.generate(spark, ["a", "b"], 100, 10, 3).filter("metric = 'b'").select("ts", "value").collect() == [(100, 10.0), (110, 11.0), (120, 12.0)]
