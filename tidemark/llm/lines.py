"""Line deduplication: MinHash of character shingles, banding, exact verification, union-find. Native throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, join_by_group, let, salted_join, sheltered
from .groups import ALIKE, WORDS, members_of, roots_of

SHINGLE = 8
#: At a similarity of 0.8, eight bands of three rows bring 99.7 % of pairs together.
BANDS, ROWS = 8, 3
#: Shingles that one row takes at once.
CHUNK = 16
#: Lines that nothing needs are ruled out before a shuffle by a bit map of 2^WORD_BITS words of 64 bits, 16 MB at most.
WORD_BITS = 20
#: Bytes of the lines to remove that are broadcast at most.
SMALL = 16 << 20
LAST = (1 << 63) - 1
#: A character that isn't blank.
INK = r"[^\x20\x09-\x0D]"


def _mask(i: int) -> int:
    """The i-th of a fixed sequence of signed 64-bit words."""
    # The constants of SplitMix64.
    x = (i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def _wide(line: Column) -> Column:
    """A line with four bytes a character, so that any shingle is found at once."""
    return F.encode(line, "UTF-32")


def _hash(wide: Column, at: Column) -> Column:
    """The hash of the shingle that begins at a character, from 0."""
    return F.xxhash64(F.substring(wide, at * 4 + 1, F.lit(4 * SHINGLE)))


def _last(wide: Column) -> Column:
    """Where the last shingle begins; a line of fewer characters is one shingle."""
    return F.greatest((F.length(wide) / 4).cast("int") - SHINGLE, F.lit(0))


def shingles(line: Column) -> Column:
    """The set of a line's shingles, by 64-bit hash."""
    return F.array_distinct(let(_wide(line), lambda w: F.transform(F.sequence(F.lit(0), _last(w)), lambda at: _hash(w, at))))


def _ordered(h: Column, i: int) -> Column:
    """The place of a hash in the i-th order: its bits turned by a step of their own and masked, so that each order is ruled by other bits."""
    turn = 11 * i % 64
    turned = F.shiftleft(h, turn).bitwiseOR(F.shiftrightunsigned(h, 64 - turn)) if turn else h
    return turned.bitwiseXOR(F.lit(_mask(i)))


def signatures(lines: DataFrame) -> DataFrame:
    """``l0, l1, n, bands`` of lines ``l0, l1, line``, one row a distinct line: its number, and of each order of shingles the least, hashed band by band.

    A row hashes a chunk of shingles and takes its least values before rows meet; a last chunk repeats its last shingle.
    """
    wide = lines.select("l0", "l1", _wide(F.col("line")).alias("wide"))
    chunks = wide.select("l0", "l1", "wide", _last(F.col("wide")).alias("last"), F.explode(F.sequence(F.lit(0), _last(F.col("wide")), F.lit(CHUNK))).alias("at"))
    hashed = chunks.select("l0", "l1", "at", *[_hash(F.col("wide"), F.least(F.col("at") + k, F.col("last"))).alias(f"h{k}") for k in range(CHUNK)])
    least = hashed.groupBy("l0", "l1").agg(F.count(F.when(F.col("at") == 0, True)).alias("n"), *[F.min(F.least(*[_ordered(F.col(f"h{k}"), i) for k in range(CHUNK)])).alias(f"m{i}") for i in range(BANDS * ROWS)])
    keys = [F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)]
    return least.select("l0", "l1", "n", F.array(*keys).alias("bands"))


def sketches(texts: DataFrame) -> DataFrame:
    """``nid, size, w0..`` of ``nid, line``: the number of shingles, and parities of how many of them fall in each place.

    Two sketches differ in no more places than two sets in shingles.
    """
    zero, step = F.lit(0).cast("long"), CHUNK // 2
    sets = texts.select("nid", shingles(F.col("line")).alias("own"))
    chunks = sets.select("nid", "own", F.explode(F.sequence(F.lit(0), F.size("own") - 1, F.lit(step))).alias("at"))
    each = chunks.select("nid", F.size("own").alias("size"), (F.size("own") - F.col("at")).alias("left"), *[F.coalesce(F.get("own", F.col("at") + k), zero).alias(f"h{k}") for k in range(step)])
    bit = "shiftleft(if(left > {k}, 1L, 0L), cast(shiftrightunsigned(h{k}, 8) & 63 as int))"
    placed = each.select("nid", "size", *[F.expr(f"cast(h{k} & {WORDS - 1} as int)").alias(f"p{k}") for k in range(step)], *[F.expr(bit.format(k=k)).alias(f"b{k}") for k in range(step)])
    word = lambda w: reduce(Column.bitwiseXOR, [F.when(F.col(f"p{k}") == w, F.col(f"b{k}")).otherwise(zero) for k in range(step)])
    return placed.groupBy("nid").agg(F.max("size").alias("size"), *[F.bit_xor(word(w)).alias(f"w{w}") for w in range(WORDS)])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs ``a, b, ..`` of lines, a written table, those that are alike, exactly."""
    left = salted_join(pairs, texts.select(F.col("nid").alias("a"), F.col("line").alias("x")), "a", pairs, ["a", "b"])
    both = salted_join(left, texts.select(F.col("nid").alias("b"), F.col("line").alias("y")), "b", pairs, ["a", "b"])
    sets = both.select(*pairs.columns, shingles(F.col("x")).alias("x"), shingles(F.col("y")).alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    up, down = ALIKE
    return sets.filter((up + down) * same >= up * (F.size("x") + F.size("y"))).select(*pairs.columns)


def _named(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"l0": F.xxhash64("line"), "l1": F.xxhash64(F.lit(1), "line")})


def line_roots(lines: DataFrame) -> tuple[Stage, Stage]:
    """``l0, l1, k0, k1``: the names of lines and of their roots where these differ; and by name all lines that repeat or share a band with another, among few more.

    Lines are read twice: once for their signatures, and once to be written, with their text if they share a band. No other
    line can be removed or be the first of several. ``lines``: line and any columns.
    """
    named = Stage(signatures(_named(lines.select("line"))).withColumn("nid", F.monotonically_increasing_id()), "bands")
    held, two = members_of(named.df.select("nid", "bands"), BANDS)
    paired = two.df.select(F.explode(F.array("a", "b")).alias("nid"))
    wanted = Stage(held.df.select("nid").unionByName(paired).distinct().join(named.df, "nid").select("nid", "l0", "l1"), "wanted")
    word, bit = F.expr(f"shiftrightunsigned(l0, {64 - WORD_BITS})"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(l0, {58 - WORD_BITS}) & 63 as int))")
    marked = wanted.df.select("l0", F.lit(True).alias("paired")).unionByName(named.df.filter("n > 1").select("l0", F.lit(False).alias("paired")))
    bits = marked.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("any"), F.bit_or(F.when(F.col("paired"), bit)).alias("paired"))  # 2^WORD_BITS rows at most
    told = _named(lines).withColumn("word", word).join(F.broadcast(bits), "word").filter(F.col("any").bitwiseAND(bit) != 0)
    seen = Stage(told.withColumn("line", F.when(F.col("paired").bitwiseAND(bit) != 0, F.col("line"))).drop("word", "any", "paired"), "lines")
    named.drop()
    asked = seen.df.filter(F.col("line").isNotNull()).groupBy("l0", "l1").agg(F.first("line").alias("line"))
    texts = Stage(asked.join(wanted.df, ["l0", "l1"]).select("nid", "line"), "texts")
    sketched = sketches(texts.df.join(held.df.select("nid").distinct(), "nid", "left_semi"))
    members = Stage(held.df.join(sketched, "nid").withColumn("root", F.col("nid")), "members")
    held.drop()
    roots = roots_of(members, two, lambda pairs: verified(pairs, texts.df))
    texts.drop()
    name = wanted.df
    other = roots.df.join(name.select(F.col("nid").alias("root"), F.col("l0").alias("k0"), F.col("l1").alias("k1")), "root").withColumnRenamed("node", "nid").join(name, "nid")
    moved = Stage(other.select("l0", "l1", "k0", "k1"), "moved")
    roots.drop()
    wanted.drop()
    return moved, seen


def repeated_lines(docs: DataFrame) -> Stage:
    """Lines to remove of documents ``r0, r1, rank, text``: ``r0, r1, gone``, an array of line numbers from 0."""
    lines = docs.select("r0", "r1", "rank", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.col("line").rlike(INK))
    moved, seen = line_roots(lines)
    counted = Stage(seen.df.join(moved.df, ["l0", "l1"], "left").select("r0", "r1", "rank", "pos", F.coalesce("k0", "l0").alias("k0"), F.coalesce("k1", "l1").alias("k1")), "lines")
    seen.drop()
    moved.drop()
    order = F.struct("rank", "pos", "r0", "r1")
    first = counted.df.groupBy("k0", "k1").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    late = join_by_group(counted.df, first, ["k0", "k1"], "n", counted.count()).filter(order != F.col("first"))
    gone = Stage(late.groupBy("r0", "r1").agg(F.collect_set("pos").alias("_out")), "gone")
    counted.drop()
    return gone


def _stripped(docs: DataFrame) -> DataFrame:
    """``docs``, sheltered, with ``_lines, _gone`` (counts) and ``_kept`` (the text that stays)."""
    keyed = docs.withColumns({"_r0": F.xxhash64("doc_id", "text"), "_r1": F.xxhash64(F.lit(1), "doc_id", "text")})
    gone = repeated_lines(keyed.select(F.col("_r0").alias("r0"), F.col("_r1").alias("r1"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"), "text"))
    out = gone.df.select(F.col("r0").alias("_r0"), F.col("r1").alias("_r1"), "_out")
    size = gone.df.agg(F.count("*"), F.sum(F.size("_out"))).first()
    if 32 * size[0] + 4 * (size[1] or 0) <= SMALL:  # else texts shuffle
        out = F.broadcast(out)
    met = keyed.join(out, ["_r0", "_r1"], "left")
    parts = F.split("text", "\n")
    left = let(parts, lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("_out")), lambda i: F.element_at(p, i + 1)))
    return met.select(*docs.columns, F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("_lines"), F.coalesce(F.size("_out"), F.lit(0)).cast("long").alias("_gone"), F.when(F.col("_out").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("_kept"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """What is left of each document when of all lines that are alike, in any documents, only the first stays.

    One row per input row: ``doc_id, n_lines, n_removed, kept_sha256``. Lines are alike when the Jaccard similarity of
    their sets of 8-character shingles is 0.8 or more, or over steps of such lines; the first is that of the
    smallest doc_id, then of the smallest line number. Lines and rows go by 128 bits of hash.

    Blank lines always stay. A null text has no lines, an empty one has one blank line. Lines shorter than a shingle are
    one shingle. A null id comes last; equal rows count as one document, and lose the same lines. Long texts and
    lines are taken whole. An empty table gives no rows. Other columns aren't read.
    """
    out = _stripped(docs.select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_removed"), F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The input's rows and columns with those lines cut from ``text``; ``n_chars``, where there is one, follows."""
    rows = sheltered(docs, "doc_id", "text", "n_chars")
    out = _stripped(rows).withColumn("text", F.col("_kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(rows.columns).toDF(*docs.columns)
