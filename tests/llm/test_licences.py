import random
import re

import pytest

from tidemark.llm.licences import LICENCES, scan
from tests.llm.helpers import docs


def brute(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    own = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for name, t in LICENCES.items():
        v = re.findall(r"[^\W_]+", t.lower())
        want = [tuple(v[i : i + 5]) for i in range(len(v) - 4)]
        block = 1
        while block < len(want):
            block *= 2
        want = set(want)
        for start in range(0, len(own), block):
            share = len(want & set(own[start : start + 2 * block])) / len(want)
            if share >= 0.8:
                best, first = out.get(name, (0, start))
                out[name] = (max(best, share), min(first, start))
    return out


def test_equals_exact_windows(spark):
    rng = random.Random(2)
    texts = [None, "", "only four words here", LICENCES["mit"].upper(), "x " * 20_000 + LICENCES["apache-2.0"] + " y" * 20_000]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(list(LICENCES.values())).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"edit{rng.randint(0, 9)}"
            parts += [" ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 40))), " ".join(own[: rng.randint(len(own) // 2, len(own))])]
        texts.append(rng.choice(["\n", " -- "]).join(parts))
    rows = list(enumerate(texts)) + [(None, LICENCES["bsd"]), (3, LICENCES["mit"].upper())]
    got = {(r.doc_id, r.template): (round(r.containment, 9), r.from_word) for r in scan(docs(spark, rows)).collect()}
    want = {(d, n): (round(c, 9), s) for d, t in rows for n, (c, s) in brute(t).items()}
    assert got == want and len(want) > 40


def test_limits(spark):
    assert scan(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        scan(docs(spark, []), {"short": "all rights reserved"})
