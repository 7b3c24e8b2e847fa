import random

import pytest

from tidemark.llm.exact import drop_exact_copies, exact_groups
from tests.llm.helpers import docs


def test_exact_groups(spark):
    rows = [(3, "a  b"), (1, "a b"), (2, "a\n\tb"), (4, " a b"), (5, None), (6, ""), (None, "a b"), (9, "z" * 100_000), (8, "z" * 100_000), (8, "z" * 100_000), (None, "q"), (10, "alone")]
    got = [(r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.kept) for r in exact_groups(docs(spark, rows)).collect()]
    want = [(-1, 1, 4, False), (-1, None, 1, True), (1, 1, 4, True), (2, 1, 4, False), (3, 1, 4, False), (4, 4, 1, True), (5, 5, 2, True), (6, 5, 2, False), (8, 8, 3, False), (8, 8, 3, True), (9, 8, 3, False), (10, 10, 1, True)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert exact_groups(docs(spark, [])).count() == 0
    kept = drop_exact_copies(docs(spark, [(1, "a b"), (2, "a  b"), (3, "c")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    kept = drop_exact_copies(docs(spark, [(1, "a b"), (1, "a  b"), (None, "c"), (None, "c"), (None, "a b"), (1, "d"), (1, "d")]))
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect() if r.text not in ("a b", "a  b")) == ["(1, 'd')", "(None, 'c')"] and kept.count() == 3


@pytest.mark.parametrize("most_bits", [1 << 28, 1 << 11])
def test_small_filters_give_the_same(spark, most_bits):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randint(0, 400)}") for i in range(600)]
    first, count = {}, {}
    for i, t in rows:
        first[t], count[t] = min(first.get(t, i), i), count.get(t, 0) + 1
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(docs(spark, rows), most_bits=most_bits).collect()}
    assert got == {(i, first[t], count[t], first[t] == i) for i, t in rows}
