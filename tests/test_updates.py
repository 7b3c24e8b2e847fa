"""Golden updates: archives, batches and what a fetch then reads."""

import pytest

from tidemark.functions.scalars import InvalidTime
from tidemark.operators.updates import File, propagation_range

NOW = 1411628779
POINTS = "ts bigint, vals array<double>"


def batch(spark, steps, n=2, null=()):
    return spark.createDataFrame([(NOW - i, [None if i in null else float(10 * j + i) for j in range(n)]) for i in steps], POINTS)


def read(file, start, until=None, now=NOW):
    range_, rows = file.fetch(start, until, now)
    by = {}
    for r in rows.collect():
        by.setdefault(r.ts, {})[r.metric] = r.value
    out = [tuple(by[t][m] for m in file.tags) for t in sorted(by)]
    return range_, [None if all(v is None for v in row) else row for row in out]


def first(spark):
    return File(spark, ["a", "b"], [(1, 6), (3, 6)], 1.0, "min", checkpoint=lambda df: spark.createDataFrame(df.collect(), df.schema))


def second(spark, archives=((1, 60), (3, 60)), tags=("a", "b")):
    return File(spark, list(tags), list(archives), 5, "min", checkpoint=lambda df: spark.createDataFrame(df.collect(), df.schema))


def test_basic(spark):
    f = first(spark)
    f.update(batch(spark, range(1, 6)), NOW)
    r, rows = read(f, NOW - 5)
    assert (r.step, r.start, r.until) == (1, NOW - 5, NOW)
    assert rows == [(5, 15), (4, 14), (3, 13), (2, 12), (1, 11)]


def test_propagate(spark):
    f = first(spark)
    f.update(batch(spark, range(1, 7)), NOW)
    r, rows = read(f, NOW - 7)
    assert (r.step, r.start, r.until) == (3, 1411628772, 1411628781)
    assert rows == [(5, 15), (2, 12), None]


def test_null(spark):
    f = first(spark)
    f.update(batch(spark, range(1, 7), null=(5, 6)), NOW)
    assert read(f, NOW - 7)[1] == [None, (2, 12), None]


def test_old_points_keep_the_greatest_vector(spark):
    f = first(spark)
    f.update(batch(spark, range(7, 13)), NOW)
    r, rows = read(f, NOW - 13)
    assert (r.step, r.start, r.until) == (3, 1411628766, 1411628781)
    assert rows == [(12, 22), (10, 20), (7, 17), None, None]


def test_empty(spark):
    r, rows = read(first(spark), 1411628775)
    assert r.step == 1 and rows == [None] * 4


def test_lost_point(spark):
    f = second(spark)
    f.update(batch(spark, range(30, 45)), NOW)
    f.update(batch(spark, range(15)), NOW, mtime=NOW - 44)
    r, rows = read(f, NOW - 61)
    assert r.step == 3 and len(rows) == 21
    assert rows == [None] * 5 + [(44, 54), (41, 51), (38, 48), (35, 45), (32, 42), (30, 40)] + [None] * 4 + [(14, 24), (11, 21), (8, 18), (5, 15)] + [None] * 2


def test_special_start(spark):
    f = second(spark)
    f.update(batch(spark, range(10, 20)), NOW)
    f.update(batch(spark, range(1, 7)), NOW, mtime=NOW - 19)
    start = 1411628760
    _, rows = read(f, start, start + 15, start + 61)
    assert rows == [(17, 27), (14, 24), (11, 21), (10, 20), (5, 15)]


def test_gap_kept(spark):
    f = second(spark)
    f.update(batch(spark, (1, 2, 4, 5)), NOW)
    assert read(f, NOW - 5)[1] == [(5, 15), (4, 14), None, (2, 12), (1, 11)]


def test_three_levels(spark):
    f = second(spark, ((1, 60), (3, 60), (6, 60)), ("a", "b", "c"))
    f.update(batch(spark, range(19, 30), n=3), NOW)
    f.update(batch(spark, (), n=3), NOW, mtime=NOW - 29)
    start = 1411628748
    r, rows = read(f, start, 1411628760, start + 181)
    assert r.step == 6 and rows == [(26, 36, 46), (20, 30, 40)]


def test_ring_overwrites_and_edges(spark):
    f = File(spark, ["a"], [(1, 6)], 1, "min")
    f.update(batch(spark, (6, 7, -3, 0), n=1), NOW)
    kept = {(r.slot_ts, r.value) for r in f.state.collect()}
    assert kept == {(NOW, 0.0), (NOW + 3, -3.0)}  # NOW - 6 and NOW share a place; NOW - 7 is too old
    assert f.fetch(NOW + 5, NOW + 9, NOW) is None
    with pytest.raises(InvalidTime):
        f.fetch(NOW, NOW, NOW)
    r, rows = f.fetch(NOW - 1, None, NOW)
    assert rows.count() == 1


def test_propagation_range():
    assert propagation_range(12, 13, 1, 3, 5) is None
    assert propagation_range(15, 16, 1, 3, 5) == (0, 15)
    assert propagation_range(1, 31, 1, 3, 5) == (0, 30)
    assert propagation_range(2, 7, 1, 6, 0.5) == (0, 12)
