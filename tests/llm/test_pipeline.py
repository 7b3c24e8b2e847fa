import os

import pytest
from pyspark.sql import functions as F

from tidemark.llm.packing import encoder
from tidemark.llm.queries import tokenizer_path
from tests.llm import test_lines, test_near
from tests.llm.helpers import roots
from tests.llm.test_mixing import plain_targets

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(corpus_pipeline.STAGES)
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row string, root string"
LABELS = "doc_id long, quality int, toxic int"


def tables(spark, tmp_path, rows, labels=()):
    full = [(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows]
    spark.createDataFrame(full, DOCUMENTS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(labels), LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))


def fixture_rows():
    words = [f"w{i:03d}" for i in range(400)]
    body = lambda i: " ".join(words[(i * 37 + k * (i % 7 + 1)) % 400] for k in range(60))
    rows = [(i, f"{body(i)}\nline of document {i} alone {i * i}\nthe same footer stands below every text", f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, body(i) + f" and some more {i}", "s1") for i in range(8)]
    rows += [(200, "scum idiot loser scum", "s0"), (None, "scum idiot loser scum", "s0"), (None, body(50), None), (None, body(50), None), (201, None, "s2"), (202, "", "s2"), (203, " \n\t", None), (7, "another text of the same id", "s1"), (7, "another text of the same id", "s1")]
    return rows


def key(r):
    return str((r.doc_id, r.text, r.source))


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage on its own input, with nulls, blanks, repeated ids and rows, and extra columns."""
    sf_dir, docs = tables(spark, tmp_path, fixture_rows())
    out, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, sf_dir).write.parquet(str(tmp_path / name))
        out[name] = kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == docs.columns
    rows = {n: f.collect() for n, f in out.items()}

    clean = [r for r in docs.collect() if "scum" not in (r.text or "")]
    assert sorted(map(key, rows["toxicity"])) == sorted(map(key, clean))

    hashed = test_lines.dedup_lines(out["toxicity"]).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    want = test_lines.brute([(r.doc_id, r.text) for r in rows["toxicity"]])
    assert sorted((r[0] if r[0] is not None else 2**63 - 1, *r[1:]) for r in hashed) == want
    import hashlib

    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(digest(r.text) for r in rows["line_dedup"]) == sorted(w[3] for w in want)

    given = sorted(rows["line_dedup"], key=lambda r: (r.doc_id is None, r.doc_id or 0))
    empty = [not (r.text or "").split() for r in given]
    same = lambda i, j: (empty[i] and empty[j]) or (empty[i] == empty[j] and test_near.jaccard(given[i].text, given[j].text) >= 0.8)
    root = roots([(i, j) for i in range(len(given)) for j in range(i + 1) if i == j or same(i, j)])
    assert len(rows["near_dedup"]) == len(set(root.values()))
    least = {root[i]: min((given[j].doc_id is None, given[j].doc_id or 0) for j in root if root[j] == root[i]) for i in root}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows["near_dedup"]) == sorted(least.values())

    size = lambda t: len((t or "").split())
    sizes, taken = {}, {}
    for r in rows["near_dedup"]:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    for r in rows["mixing"]:
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    assert {s: taken.get(s, 0) for s in sizes} == {s: int(t + 1e-9) for s, t in plain_targets(sizes).items()}

    pieces = STAGES["packing"](spark, out["mixing"], sf_dir).collect()
    encode = encoder(tokenizer_path())
    assert sum(p.length for p in pieces) == sum(len(encode(r.text or "")) + 1 for r in rows["mixing"])
    at = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at.get(p.sequence_id, 0)
        at[p.sequence_id] = p.offset + p.length
    assert max(at.values()) <= 2048
    result = corpus_pipeline.run(spark, sf_dir)
    assert sorted(result.columns) == sorted(pieces[0].asDict()) and sorted((r.length, r.ids_crc32) for r in result.collect()) == sorted((p.length, p.ids_crc32) for p in pieces)


def test_empty_tables(spark, tmp_path):
    sf_dir, docs = tables(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_run_on_the_smallest_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    result = corpus_pipeline.run(spark, sf_dir).cache()
    rooms = result.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert rooms.agg(F.max("n")).first()[0] <= 2048
    assert 0 < result.select("doc_id").distinct().count() <= start.count()
