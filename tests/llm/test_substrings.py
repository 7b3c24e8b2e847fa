import hashlib
import random

import pytest

from tidemark.llm.substrings import cut_repeated_passages, repeated_passages
from tests.llm.helpers import docs


def brute(rows, window):
    rows = [(d if d is not None else 2**63 - 1, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in rows:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in rows:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < d:
                gone |= set(range(s, s + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window,seed", [(50, 8), (6, 3)])
def test_equals_brute_force(spark, window, seed):
    rng = random.Random(window)
    words = [f"w{i}" for i in range(40)] + ["é", "a"]
    passages = [[rng.choice(words) for _ in range(rng.randint(window - 2, 3 * window))] for _ in range(6)]
    rows = [(1, None), (2, ""), (None, " ".join(passages[0])), (3, "x " * 300), (4, "x " * 200), (5, "y " * (window - 1))]
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 2 * window))]
            if text and rng.random() < 0.3:
                text[rng.randrange(len(text))] = "edit"
        rows.append((100 - i, rng.choice([" ", "\n", "  "]).join(text)))
    rows.append(rows[-1])
    got = sorted((r.doc_id if r.doc_id is not None else 2**63 - 1, r.n_words, r.n_removed, r.kept_sha256) for r in repeated_passages(docs(spark, rows), window, seed).collect())
    assert got == brute(rows, window)
    assert sum(r[2] for r in got) > 0


def test_cut_and_empty(spark):
    text = " ".join(f"a{i}" for i in range(60))
    out = cut_repeated_passages(docs(spark, [(1, text), (2, "x  y " + text + " z"), (3, "p  q")]))
    assert {r.doc_id: r.text for r in out.collect()} == {1: text, 2: "x y z", 3: "p  q"}
    assert out.columns == docs(spark, []).columns
    assert repeated_passages(docs(spark, [])).count() == 0
