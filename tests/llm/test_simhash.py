import numpy as np
import pytest

from tidemark.llm import simhash
from tests.llm.helpers import docs, roots


def brute(fps):
    return roots([(int(a), int(b)) for i, a in enumerate(fps) for b in fps[: i + 1] if bin(int(a) & (2**64 - 1) ^ int(b) & (2**64 - 1)).count("1") <= 3])


def test_golay_covering():
    for width in (21, 22):
        _, _, masks = simhash.golay_tables(width)
        assert (masks[:, 0] != 0).sum() == 2047
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 22, 500)
    for bit in range(22):
        stored, _ = simhash.codewords(words ^ (1 << bit), 22)
        sought, used = simhash.codewords(words, 22)
        assert ((sought == stored[:, :1]) & used).any(axis=1).all()


@pytest.mark.parametrize("paired", [2048, 4])
def test_links_connect_as_all_pairs_do(spark, paired):
    rng = np.random.default_rng(7)
    fps = list(rng.integers(-(2**63), 2**63 - 1, 30, dtype=np.int64))
    for centre in fps[:4]:
        at = int(centre)
        for _ in range(25):
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                at ^= 1 << int(bit) if bit < 63 else -(1 << 63)
            fps.append(np.int64(at))
    fps = sorted({int(x) for x in fps})
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"), paired).collect()
    assert roots([(x, x) for x in fps] + [(a, b) for a, b in links]) == brute(fps)


def test_documents(spark):
    long = " ".join(f"w{i % 977}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three four"), (4, "one two three four"), (9, "ONE two\nthree four"), (5, "One"), (None, "one two three four"), (6, long), (7, long)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_groups(docs(spark, rows)).collect())
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in got}
    assert {by_id[i][1:] for i in (1, 2, 3)} == {("0" * 16, 1)}
    assert {by_id[i][2] for i in (4, 9, -1)} == {4} and by_id[5][2] == 5 and by_id[7][2] == 6
    import xxhash

    assert by_id[5][1] == f"{xxhash.xxh64_intdigest(b'one', 42):016x}"
    assert simhash.near_groups(docs(spark, [])).count() == 0
    kept = simhash.drop_near_copies(docs(spark, [(1, "a b c d"), (2, "a b c d"), (3, "e f g h")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns[-1] == "_id"


def plain_fingerprint(text):
    """Bit by bit, with words by regular expression."""
    import re

    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_the_definition():
    rng = np.random.default_rng(4)
    parts = ["Aa", "ÀÉ", "ß", "b\x1c", "\x85", "C\u3000d", "\xa0", "e-f", "ZZ", "漢字", " ", "\t\n", "\x0b", "x"]
    for n in (0, 1, 2, 3, 5, 40, 300):
        for _ in range(20):
            text = " ".join(rng.choice(parts, n))
            assert simhash.fingerprint(text) == plain_fingerprint(text), repr(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
