import numpy as np

from tidemark.llm import ann
from tidemark.llm.ann import nearest
from tidemark.llm.common import Stage
from tidemark.llm.hnsw import Graph

SCHEMA = "vec_id long, embedding array<float>, vector string, query string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", "y") for i, v in rows], SCHEMA)


def brute(rows, k=20):
    out = {}
    fine = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    for q, x in fine:
        if q % 20 == 0:
            hits = sorted(((-float(x @ y), i) for i, y in fine if i != q and len(y) == len(x)))[:k]
            out[q] = [(i, -s) for s, i in hits]
    return out


def got(frame_, **kw):
    out = {}
    for r in sorted(nearest(frame_, **kw).collect()):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_graph_recall():
    x = np.random.default_rng(0).normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = Graph(x).search(x[:100], 128)[:, :20]
    exact = np.argsort(-(x[:100] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, exact)]) > 0.95


def test_recall_and_scores_over_shards(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8) * rng.uniform(0.2, 3)) for i in range(1500)]
    want, found = brute(rows), got(frame(spark, rows), shard_rows=400)
    assert set(want) == set(found)
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in found[q]}) / 20 for q in want]) >= 0.95
    for q, hits in found.items():
        for i, s in hits:
            assert abs(s - np.float32(rows[q][1]).astype(float) @ np.float32(rows[i][1]).astype(float)) < 1e-9


def test_odd_rows_and_copies(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(60)] + [(100, [0.5, 0.5]), (101, None), (102, []), (103, [0.0, 0.0]), (104, [float("nan"), 1.0]), (105, [None, 1.0]), (120, [float("inf"), 1]), (140, [1.0, 0.0, 0.0]), (141, [0.0, 1.0, 0.0]), (None, same)]
    want, found = brute(rows), got(frame(spark, rows))
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert found[0][0] == (1, 5.0) and len(found[140]) == 1
    assert nearest(frame(spark, [])).count() == 0


def test_doubles_stay_doubles(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.normal(size=6) * 1e60]) for i in range(100)]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    for q, hits in got(frame_).items():
        order = sorted(((-float(x[q] @ x[i]), i) for i in range(100) if i != q))[:20]
        assert [i for i, _ in hits] == [i for _, i in order] and all(s == -want or abs(s / want + 1) < 1e-12 for (_, s), (want, _) in zip(hits, order, strict=True))


def test_recall_on_the_embeddings(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect()]
    want, found = brute(rows), got(vectors, shard_rows=400)
    assert set(want) == set(found)
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in found[q]}) / max(len(want[q]), 1) for q in want]) >= 0.95


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    """Blocks of queries are small, but go to every shard."""
    plans = {}

    class Told(Stage):
        def __init__(self, df, tag, batch=None):
            plans[tag] = df._jdf.queryExecution().executedPlan().toString()
            super().__init__(df, tag, batch)

    monkeypatch.setattr(ann, "Stage", Told)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8)) for i in range(400)]
    want, found = brute(rows), got(frame(spark, rows), shard_rows=20, width=64)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert "SortMergeJoin" in plans["hits"] and "BroadcastExchange" not in plans["hits"]
