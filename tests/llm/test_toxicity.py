import zlib

import numpy as np

from tidemark.llm.models import LabelModel
from tidemark.llm.toxicity import choose, drop_toxic, score_toxicity, weighed
from tests.llm.helpers import docs

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=300):
    base = "some plain words about weather trees and rivers number"
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        rows.append((i, f"{base} {i} " + (f"zorg{'abcdefg'[i % 7]}la is zorg{'hijkm'[i % 3]}bet and scum " if toxic else "calm water ") * 3))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learns_and_respects_held_out(spark):
    rows, labels = corpus()
    extra = [(1000, None), (1001, ""), (1002, "zorgnew and zorgold with zorgfla"), (1002, "zorgnew and zorgold with zorgfla"), (None, "calm water"), (1003, "calm water " * 40_000)]
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (9999, 0, 1)], LABELS)
    got = score_toxicity(docs(spark, rows + extra), table).collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        assert r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id is not None and r.doc_id < 300:
            assert r.predicted == int(r.doc_id % 5 == 0)
    by = {r.doc_id: r.predicted for r in got}
    assert by[1000] == by[1001] == by[None] == by[1003] == 0 and by[1002] == 1
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels], LABELS)
    again = score_toxicity(docs(spark, rows + extra), flipped).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    kept = drop_toxic(docs(spark, rows), table)
    assert kept.count() == 240 and kept.columns == docs(spark, []).columns


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    got = {r.doc_id: r.predicted for r in score_toxicity(docs(spark, [(1, "a calm day"), (2, "scum scum idiot loser")]), none).collect()}
    assert got == {1: 0, 2: 1}
    assert score_toxicity(docs(spark, []), none).count() == 0


def test_label_model_overrules_wrong_labels():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < 0.9, np.where(truth, 1, -1), np.where(truth, -1, 1)) for _ in range(7)], axis=1)
    votes = np.column_stack([votes, votes[:, 0]]).astype(float)
    label = np.where(np.arange(4000) < 2000, truth, -1).astype(int)
    label[:200] = 1 - label[:200]
    model = LabelModel().fit(lambda measure: measure(votes, label, np.ones(4000)))
    post = model.posterior(votes, label)
    assert abs(model.accuracies()[1:7] - 0.9).max() < 0.03
    assert abs(np.exp(model.label_rates).diagonal() - 0.9).max() < 0.03
    assert model.correlations[0, 7] > 0.9 and model.weights[0] < 0.7 * model.weights[1]
    assert ((post > 0.5) == truth)[:200].mean() > 0.9  # wrong labels are overruled
    assert ((post > 0.5) == truth)[200:].mean() > 0.97  # unlabelled rows have posteriors as well


def test_stems_exclude_each_other(spark):
    counts = spark.createDataFrame([("vex", 40, 0), ("vex*", 90, 0), ("ve*", 95, 60), ("the", 100, 900), ("rare", 2, 0), ("clean", 0, 50)], "stem string, toxic long, clean long")
    scored = {r.stem: r.evidence for r in weighed(counts, 100, 900).collect()}
    assert set(scored) == {"vex", "vex*", "ve*"}
    plain = lambda part, size, rate: part * np.log(part / (size * rate)) if part else 0
    assert abs(scored["vex*"] - 2 * (plain(90, 100, 0.09) + plain(10, 100, 0.91) + plain(0, 900, 0.09) + plain(900, 900, 0.91))) < 1e-5
    assert choose(list(scored.items())) == ["vex*"]


def test_held_out_rows_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = score_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    found = sum(r.predicted for r in got if r.toxic == 1) / sum(r.toxic for r in got)
    wrong = sum(r.predicted for r in got if r.toxic == 0) / sum(1 - r.toxic for r in got)
    assert found >= 0.9 and wrong <= 0.01


def test_drops_toxic_rows_with_null_and_repeated_ids(spark):
    none = spark.createDataFrame([], LABELS)
    rows = [(None, "scum scum idiot loser"), (None, "a calm day"), (4, "scum scum idiot loser"), (4, "a calm day"), (4, "a calm day")]
    assert sorted(str(r.doc_id) + r.text for r in drop_toxic(docs(spark, rows), none).collect()) == ["4a calm day", "4a calm day", "Nonea calm day"]
