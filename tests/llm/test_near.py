import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import near
from tidemark.llm.near import BANDS, drop_near_copies, shingles, sketch
from tidemark.llm.simhash import voted
from tests.llm.helpers import docs, roots


def near_pairs(rng, n, edits, words):
    """Random texts, each with a copy in which some words are replaced."""
    out = []
    for _ in range(n):
        own = [f"w{x}" for x in rng.integers(0, 50_000, words)]
        copy = list(own)
        for at in rng.choice(words, max(1, int(edits * words)), replace=False):
            copy[at] = f"x{rng.integers(0, 50_000)}"
        out += [" ".join(own), " ".join(copy)]
    return out


def jaccard(a, b):
    """By sets of the words themselves."""
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_copies_go_as_by_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [t for words in (30, 60, 200, 600) for edits in (0.01, 0.02, 0.03, 0.05) for t in near_pairs(rng, 6, edits, words)]
    base = [f"b{i}" for i in range(150)]
    for i in range(40):  # a group of copies with edits of their own
        copy = list(base)
        copy[i * 3], copy[149 - i * 3] = f"y{i}", f"z{i}"
        texts.append(" ".join(copy))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1) if i == j or jaccard(texts[i], texts[j]) >= 0.8]
    got = {r.doc_id for r in drop_near_copies(docs(spark, list(enumerate(texts)))).collect()}
    assert len(pairs) > len(texts) + 30
    assert got == set(roots(pairs).values())


def test_sketches_never_rule_out_too_much():
    rng = np.random.default_rng(2)
    for text, copy in zip(*[iter(near_pairs(rng, 40, 0.03, 400))] * 2, strict=True):
        a, b = shingles(text), shingles(copy)
        assert np.bitwise_count(sketch(a) ^ sketch(b)).sum() <= len(np.setxor1d(a, b))


def test_nulls_blanks_and_repeats(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, long), (7, long + " end"), (7, long + " end"), (8, "One two"), (9, "one\ntwo"), (None, "alone here"), (None, "alone here"), (7, "other words stand in this one")]
    got = [(r.doc_id, r.text) for r in drop_near_copies(docs(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, None), (7, long + " end"), (8, "One two"), (None, "alone here"), (7, "other words stand in this one")]))
    assert drop_near_copies(docs(spark, [])).count() == 0


def test_fingerprints_alone_find_what_is_within_three_bits(spark, monkeypatch):
    """The same without MinHash's keys: of texts that fingerprints connect, those go that are alike."""
    members_of, seen = near.members_of, []

    def fingerprints_only(named, bands):
        seen.append(bands)
        return members_of(named.withColumn("bands", F.slice("bands", BANDS + 1, 1)), 1)

    monkeypatch.setattr(near, "members_of", fingerprints_only)
    texts = near_pairs(np.random.default_rng(4), 30, 0.001, 400) + near_pairs(np.random.default_rng(6), 10, 0.1, 100) + ["", "One two", "one  TWO"]
    prints = [voted(shingles(t)) for t in texts]
    within = roots([(i, j) for i in range(len(texts)) for j in range(i + 1) if (prints[i] ^ prints[j]).bit_count() <= 3])
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1) if i == j or within[i] == within[j] and jaccard(texts[i], texts[j]) >= 0.8]
    got = {r.doc_id for r in drop_near_copies(docs(spark, list(enumerate(texts)))).collect()}
    assert seen == [BANDS + 1] and len(pairs) > len(texts) + 15
    assert got == set(roots(pairs).values())
