import numpy as np

from tidemark.llm.quality import CoTraining, score_quality
from tests.llm.helpers import docs

LABELS = "doc_id long, quality int, toxic int"


def test_views_teach_each_other():
    rng = np.random.default_rng(3)
    n = 4000
    y = (rng.random(n) < 0.8).astype(float)
    views = [np.column_stack([y * 2 + rng.normal(size=n), rng.normal(size=(n, 3))]) for _ in range(2)]
    few = np.arange(n) < 120
    check = np.arange(120) % 4 == 3
    model = CoTraining().fit([v[few] for v in views], y[few], [v[~few] for v in views], check)
    assert min(model.passed) > 50
    a, b, both = model.scores([v[~few] for v in views])
    right = [((s >= 0.5) == y[~few]).mean() for s in (a, b, both)]
    assert right[2] >= max(right[:2]) and right[2] > 0.88


def test_scores_every_row(spark):
    good = "Plain sentences follow one another here, number {} of many. They say little."
    rows = [(i, ("SPAM!! " * (20 + i % 7)) if i % 4 == 0 else good.format(i) * (1 + i % 3)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (3, None, 0)], LABELS)
    extra = [(900, None), (901, ""), (901, ""), (None, good), (902, "word " * 60_000)]
    got = score_quality(docs(spark, rows + extra), labels).collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        assert 0 <= r.score <= 1 and r.keep == int(r.score >= 0.5)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.keep == int(r.doc_id % 4 != 0), r
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in score_quality(docs(spark, [(1, "x")]), none).collect()} == {0.5}
    assert score_quality(docs(spark, []), none).count() == 0


def test_every_row_without_a_label_takes_part(spark):
    """Also those beyond 20,000, and those with null and repeated ids; sums in Spark fit as arrays do."""
    from tidemark.llm.quality import CONTENT, METADATA, Pool, _rows, fit

    text = "case when id % 4 = 0 then repeat('SPAM!! ', cast(20 + id % 7 as int)) else concat('Plain sentences follow here, number ', id, ' of many.') end"
    frame = spark.range(20_700).selectExpr("case when id >= 20600 then null when id >= 20500 then 20499 else id end as doc_id", "'s' as source", "'en' as lang", f"{text} as text")
    rows = frame.mapInArrow(_rows, "doc_id long, content binary, metadata binary").cache()
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)], LABELS)
    model = fit(rows, labels, 20_000)
    assert model.pool == 20_300 and min(model.passed) >= 0.09 * 20_300
    got = sorted(rows.filter("doc_id < 400").collect())
    rng = np.random.default_rng(4)
    check = np.arange(len(got)) % 4 == 3
    y = np.array([float(r.doc_id % 4 != 0) for r in got])
    views = [np.stack([np.frombuffer(r[i], dtype=np.float32) for r in got]) for i in (1, 2)]
    free = rows.filter("doc_id is null or doc_id >= 400").select("content", "metadata")
    mixed = rng.permutation(np.array(free.collect(), dtype=object))
    pools = [np.stack([np.frombuffer(r[i], dtype=np.float32) for r in mixed]) for i in (0, 1)]
    assert pools[0].shape == (20_300, CONTENT) and pools[1].shape == (20_300, METADATA)
    far, near = CoTraining().fit(views, y, Pool(free), check), CoTraining().fit(views, y, pools, check)
    assert far.passed == near.passed and all(np.allclose(a, b, atol=1e-5) for a, b in zip(far.betas, near.betas, strict=True))
