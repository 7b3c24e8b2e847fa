import hashlib
import random

from pyspark.sql import functions as F

from tidemark.llm import groups
from tidemark.llm.common import Stage
from tidemark.llm.lines import ALIKE, SHINGLE, dedup_lines, drop_repeated_lines, line_roots, shingles, signatures
from tests.llm.helpers import docs, roots


def grams(line):
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def brute(rows):
    rows = [(d if d is not None else 2**63 - 1, t) for d, t in rows]
    lines = sorted({x for _, t in rows if t is not None for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")})
    sets, pairs = [grams(x) for x in lines], [(i, i) for i in range(len(lines))]
    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if same * sum(ALIKE) >= ALIKE[0] * (len(a) + len(sets[j])):
                pairs.append((i, j))
    root, number, first = roots(pairs), {x: i for i, x in enumerate(lines)}, {}
    for d, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for pos, x in enumerate(t.split("\n")):
            if x in number:
                k = root[number[x]]
                first[k] = min(first.get(k, (d, pos, t)), (d, pos, t))
    out = []
    for d, t in rows:
        parts = t.split("\n") if t is not None else []
        kept = [x for pos, x in enumerate(parts) if x not in number or first[root[number[x]]] == (d, pos, t)]
        out.append((d, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdéfg") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(12)]

    def line():
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = word()
        return " ".join(w) if rng.random() < 0.8 else word() * rng.randint(0, 30)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t\n "), (103, "short\nshort\nshor"), (None, base[0] + "\nonly here by chance"), (5, rows[5][1])]
    rows += [(200 + i, " ".join(base[1].split()[:-1] + [f"end{i}"])) for i in range(80)]
    got = sorted((r.doc_id if r.doc_id is not None else 2**63 - 1, r.n_lines, r.n_removed, r.kept_sha256) for r in dedup_lines(docs(spark, rows)).collect())
    assert got == brute(rows)


def test_shingles_and_long_lines(spark):
    text = "xy" * 5 + "0123456789" * 300 + "ü" * 70
    got = spark.createDataFrame([(text,), ("abc",), ("abcdefgh",)], "t string").select(F.size(shingles(F.col("t"))).alias("n")).collect()
    assert [r.n for r in got] == [len(grams(text)), 1, 1]
    long = " ".join(f"word{i}" for i in range(20_000))
    out = drop_repeated_lines(docs(spark, [(1, long + "\nend of one document"), (2, "start\n" + long + " more\nstart"), (3, "all mine")]))
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (long + "\nend of one document", len(long) + 20), 2: ("start", 5), 3: ("all mine", 8)}
    assert out.columns == docs(spark, []).columns
    assert dedup_lines(docs(spark, [])).count() == 0


def test_recall_of_bands_by_length(spark):
    """Of pairs with a similarity from 0.8 to 0.85, the share that meets in a band: no less than three independent rows in eight bands give, less chance."""
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz "
    for length, least in ((30, 0.97), (80, 0.985), (300, 0.985)):
        pairs = []
        while len(pairs) < 400:
            a = "".join(rng.choice(letters) for _ in range(length))
            cut = rng.randint(1, max(1, length // 5))
            b = list(a[:-cut] if rng.random() < 0.5 else a)
            for _ in range(rng.randint(0, 1 + length // 100)):
                b[rng.randrange(len(b))] = rng.choice(letters)
            x, y = grams(a), grams("".join(b))
            if 0.8 <= len(x & y) / len(x | y) <= 0.85:
                pairs.append((a, "".join(b)))
        lines = spark.createDataFrame([(2 * i + j, j, p[j]) for i, p in enumerate(pairs) for j in (0, 1)], "l0 long, l1 long, line string")
        bands = {r.l0: set(r.bands) for r in signatures(lines).collect()}
        assert sum(bool(bands[2 * i] & bands[2 * i + 1]) for i in range(400)) / 400 >= least, length


def test_only_lines_that_matter_are_written(spark):
    """Of lines, those that repeat or share a band with another; the text only of these last."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    alone, twice, near = [text(60) for _ in range(300)], text(60), text(200)
    every = [*alone, twice, near, near[:-3], twice, twice]
    moved, seen = line_roots(spark.createDataFrame(list(enumerate(every)), "pos long, line string"))
    got = {r.pos: r.line for r in seen.df.collect()}
    assert {300, 301, 302, 303, 304} <= got.keys() and len(got) < 20
    assert (got[301], got[302], got[300]) == (near, near[:-3], None)
    assert moved.count() == 1


def test_small_bands_are_compared_without_centres(spark, monkeypatch):
    """Bands of several groups of alike members: roots are the same with rounds of centres and without, and small bands take two comparisons only."""
    rows = [(band, 12, 100 * band, 100 * band + i) for band in range(20) for i in range(12)]
    for place, least, most in ((groups.PLACE, 2, 2), (4, 3, 9)):
        monkeypatch.setattr(groups, "PLACE", place)
        calls = []

        def verify(pairs):
            calls.append(pairs.count())
            return pairs.filter("a % 100 % 3 = b % 100 % 3")

        base = spark.createDataFrame(rows, "band long, n long, first long, nid long").withColumns({"root": F.col("nid"), "size": F.lit(50), **{f"w{w}": F.lit(0).cast("long") for w in range(groups.WORDS)}})
        two = spark.createDataFrame([(9001, 9000), (9004, 9000)], "a long, b long")
        got = {r.node: r.root for r in groups.roots_of(Stage(base, "members"), Stage(two, "two"), verify).df.collect()}
        assert got == {100 * band + i: 100 * band + i % 3 for band in range(20) for i in range(3, 12)}
        assert least <= len(calls) <= most
