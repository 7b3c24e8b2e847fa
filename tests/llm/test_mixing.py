from pyspark.sql import functions as F

from tidemark.llm.mixing import mix, mix_plan
from tests.llm.helpers import docs


def plain_targets(sizes, most=3):
    """Water-filling by repetition."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        share = {s: most * sizes[s] if s in full else weight[s] * rest / w for s in names}
        over = {s for s in names if s not in full and share[s] > most * sizes[s]}
        if not over:
            return share
        full |= over


def test_mixing_plan_and_documents(spark):
    rows = [(i, "w " * (i % 13 + 1), f"s{i % 4}") for i in range(200)] + [(500 + i, "long word list " * 400, "big") for i in range(8)]
    rows += [(900, "only  one\nhere\t", "tiny"), (901, None, None), (902, "a b c", None), (None, "x y", "s1"), (903, "", "void"), (7, "w w", "s3"), (7, "w w", "s3")]
    frame = docs(spark, rows)
    plan = mix_plan(frame).collect()
    assert len(plan) == len(rows) and sorted(map(str, plan)) == sorted(map(str, mix_plan(frame.repartition(7)).collect()))
    sizes, taken = {}, {}
    for r in plan:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets(sizes)
    for r in plan:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    unique = frame.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    words = unique.transform(mix_plan).groupBy("doc_id").agg(F.sum("taken").alias("t"))
    mixed = mix(unique)
    assert mixed.columns == frame.columns
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    assert got == {r.doc_id: r.t for r in words.collect() if r.t}
    assert mix_plan(docs(spark, [])).count() == 0


def test_mix_keeps_to_the_plan_with_null_and_repeated_ids(spark):
    rows = [(i, "w " * (i % 5 + 1), f"s{i % 3}") for i in range(30)] + [(7, "a b", "s1"), (7, "a b", "s1"), (None, "x y z", "s1"), (None, "x y z", "s1"), (None, "q", None)]
    frame = docs(spark, rows)
    want = {(r.doc_id, r.source): r.t for r in mix_plan(frame).groupBy("doc_id", "source").agg(F.sum("taken").alias("t")).collect() if r.t}
    got = mix(frame).groupBy("doc_id", "source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("t")).collect()
    assert {(r.doc_id, r.source): r.t for r in got} == want and any(k[0] is None for k in want)
