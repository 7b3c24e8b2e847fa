"""SimHash near-duplicates by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BATCH, Stage, join_by_group, tidy
from .graph import components

MOST_BITS = 3
SHINGLE = 3
SEED = 42
#: The fingerprint's segments as (lowest bit, width); each is a shortened word of the Golay code.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Rows of a key that are compared with each other; larger groups go by ``_flips``.
PAIRED = 2048
#: Links that a task gathers before it reduces them to a forest.
HELD_PAIRS = 1 << 17

#: Fixed value: a generator polynomial of the binary [23, 12, 7] Golay code.
GENERATOR = 0b110001110101


def voted(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes: the bits that over half of them have; 0 of none."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    return voted(np.array([digest(s, SEED) for s in shingles], dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


@lru_cache
def golay_tables(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and for each syndrome the masks that lead to codewords.

    The first mask leads to the nearest codeword. All of them together lead to the nearest
    codewords of the word and of every word at one bit's distance within ``width``; unused
    places repeat the first.
    """
    unit = []
    for i in range(23):
        x = 1 << i
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        unit.append(x)
    syndrome = np.zeros(1 << 12, dtype=np.int64)
    high = np.zeros(1 << 11, dtype=np.int64)
    for i in range(12):
        syndrome[np.arange(1 << 12) >> i & 1 == 1] ^= unit[i]
    for i in range(11):
        high[np.arange(1 << 11) >> i & 1 == 1] ^= unit[12 + i]
    leader = {0: 0}
    for i in range(23):
        leader[unit[i]] = 1 << i
        for j in range(i):
            leader[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                leader[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    masks = np.zeros((1 << 11, 6), dtype=np.int64)
    for s, first in leader.items():
        others = {1 << i ^ leader[s ^ unit[i]] for i in range(width)} - {first}
        masks[s] = [first, *sorted(others), *[first] * (5 - len(others))]
    return syndrome, high, masks


def codewords(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of codewords near each word, nearest first, and which of the six places are used."""
    low, high, masks = golay_tables(width)
    near = masks[low[words & 0xFFF] ^ high[words >> 12]]
    used = np.ones(near.shape, dtype=bool)
    used[:, 1:] = near[:, 1:] != near[:, :1]
    return (words[:, None] ^ near) >> 11, used


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of (position in ``fps``, key, role); role bit 1: stored, bit 2: sought.

    Three errors at most fall on three segments. Either two segments have none, which share an exact key;
    or one has none and another has one; or each has one. A segment with one error at most shares the
    stored word's nearest codeword with one of the sought word's codewords. So two fingerprints within reach
    share a key that one stores and the other seeks.
    """
    n = len(fps)
    rows = np.arange(n)
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    codes = [codewords(p, width) for p, (_, width) in zip(parts, SEGMENTS, strict=True)]
    out = []
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        out.append((rows, (parts[i] << 22 | parts[j]) << 4 | tag, np.full(n, 3)))
    tag = 3
    for i in range(3):
        for j in range(3):
            if i != j:
                index, used = codes[j]
                for k in range(6):
                    at = np.flatnonzero(used[:, k])
                    out.append((at, (parts[i][at] << 12 | index[at, k]) << 4 | tag, np.full(len(at), 3 if k == 0 else 2)))
                tag += 1
    (a, a_used), (b, b_used), (c, c_used) = codes
    for k in range(6):
        at = np.flatnonzero(a_used[:, k])
        out.append((at, (a[at, k] << 24 | b[at, 0] << 12 | c[at, 0]) << 4 | tag, np.full(len(at), 3 if k == 0 else 1)))
    for k in range(6):
        for m in range(6):
            if k or m:
                at = np.flatnonzero(b_used[:, k] & c_used[:, m])
                out.append((at, (a[at, 0] << 24 | b[at, k] << 12 | c[at, m]) << 4 | tag, np.full(len(at), 2)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.asarray(batch.column(0)).view(np.uint64)
        for start in range(0, len(fps), 4096):
            part = fps[start : start + 4096]
            row, key, role = keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role.astype(np.int8)), pa.array(part[row].view(np.int64))], ["key", "role", "fp"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest of its component, for the links given."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for side in (x, y, root[x], root[y]):
            np.minimum.at(new, side, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _runs(batches: Iterator[pa.RecordBatch], paired: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of whole groups of equal first column, of ``paired`` rows at most each; or, marked, parts of larger groups."""
    held: list[np.ndarray] | None = None
    hot = None
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            held = None
        if hot is not None:
            of = cols[0] == hot
            yield [c[of] for c in cols], True
            cols = [c[~of] for c in cols]
        if not len(cols[0]):
            continue
        hot = None
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if len(cols[0]) - last > paired:
            hot = cols[0][-1]
            yield [c[last:] for c in cols], True
        else:
            held = [c[last:] for c in cols]
        done = [c[:last] for c in cols]
        starts = np.flatnonzero(np.r_[True, done[0][1:] != done[0][:-1]]) if last else np.zeros(0, dtype=int)
        sizes = np.diff(np.r_[starts, last])
        large = np.repeat(sizes > paired, sizes)
        if large.any():
            yield [c[large] for c in done], True
        if last and not large.all():
            yield [c[~large] for c in done], False
    if held is not None:
        yield held, False


def _paired(paired: int):
    """Of rows sorted by key: a forest of the links within each key, and fingerprints under keys with too many rows."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, role, fp), hot in _runs(batches, paired):
            if hot:
                found = np.unique(fp)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.nulls(len(found), pa.int64())], ["a", "b"])
                continue
            again = np.zeros(len(key), dtype=bool)
            again[1:] = key[1:] == key[:-1]
            again[:-1] |= again[1:]
            key, role, fp = key[again], role[again], fp[again]
            a, b, held = [], [], 0
            here = np.arange(len(key))
            shift = 1
            while len(here := here[here + shift < len(key)]):
                here = here[key[here] == key[here + shift]]
                there = here + shift
                of = ((role[here] & 1) & (role[there] >> 1)) | ((role[here] >> 1) & (role[there] & 1))
                near = here[(of == 1) & (np.bitwise_count(fp[here].view(np.uint64) ^ fp[there].view(np.uint64)) <= MOST_BITS)]
                a.append(fp[near])
                b.append(fp[near + shift])
                held += len(near)
                shift += 1
                if held > HELD_PAIRS:
                    x, y = forest(np.concatenate(a), np.concatenate(b))
                    a, b, held = [x], [y], 0
            if a and len(a := np.concatenate(a)):
                x, y = forest(a, np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return link


def _flipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All words within two bits of each fingerprint; far: 1 for two bits."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate([[np.uint64(0)], one, one[i] | one[j]])
    far = np.r_[np.zeros(65, np.int8), np.ones(len(i), np.int8)]
    for batch in batches:
        fps = np.asarray(batch.column(0)).view(np.uint64)
        for start in range(0, len(fps), 64):
            part = fps[start : start + 64]
            near = (part[:, None] ^ masks).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.tile(far, len(part))), pa.array(np.repeat(part.view(np.int64), len(masks)))], ["near", "far", "fp"])


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (near, far): what lies within two bits of a word links to what lies within one."""
    word, hub = None, None
    for batch in batches:
        near, far, fp = (np.asarray(c) for c in batch.columns)
        if not len(near):
            continue
        start = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
        first = np.repeat(start, np.diff(np.r_[start, len(near)]))
        to, has = fp[first].copy(), far[first] == 0
        if near[0] == word:
            to[first == 0], has[first == 0] = (hub if hub is not None else 0), hub is not None
        word, hub = near[-1], (to[-1] if has[-1] else None)
        of = has & (to != fp)
        if of.any():
            x, y = forest(fp[of], to[of])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def fingerprint_links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Links ``a, b`` that connect distinct fingerprints exactly as all pairs within three bits do.

    Under each key, stored and sought rows are compared and a spanning forest of the links is kept. Where
    a key has more than ``paired`` rows, its fingerprints link through the words between them instead: two
    within three bits have a word within one bit of the one and two of the other, and everything within
    two bits of a word links to anything within one bit of it. That takes 2,081 rows a fingerprint,
    however large the group.
    """
    sorted_ = fps.mapInArrow(_keyed, "key long, role byte, fp long").repartition("key").sortWithinPartitions("key")
    found = Stage(sorted_.mapInArrow(_paired(paired), "a long, b long"), "near").df
    links = found.filter("b is not null")
    crowded = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    if crowded.isEmpty():
        return links
    words = crowded.repartition(F.xxhash64("fp")).mapInArrow(_flipped, "near long, far byte, fp long")
    return links.unionByName(words.repartition("near").sortWithinPartitions("near", "far").mapInArrow(_hubs, "a long, b long"))


@tidy
def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paired: int = PAIRED) -> DataFrame:
    """Fingerprint every document and join those within three differing bits, over any number of steps.

    One row per input row: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest
    id reachable. Equal fingerprints are one node, so that copies neither pair up nor crowd a key; a
    fingerprint that many rows have is joined back by broadcast.

    Null and empty texts, and those of blanks alone, have fingerprint zero and are linked like
    others. Repeated rows repeat in the result; a null id never is a component's name unless all its
    ids are null. Long texts are read whole. An empty table gives no rows. Other columns aren't read.
    """
    prints = Stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long"), "prints", TEXT_BATCH)
    nodes = Stage(prints.df.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    roots = components(fingerprint_links(nodes.df.select("fp"), paired)).select(F.col("node").alias("fp"), "root")
    named = nodes.df.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    total = nodes.count()
    of = Stage(join_by_group(named, lowest, "root", "members", total).select("fp", "n", "component_id"), "components")
    return join_by_group(prints.df, of.df, "fp", "n", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, **named) -> DataFrame:
    """The input's rows of which one of each group of near copies stays, as ``near`` says, which finds them by these keys too."""
    from .near import drop_near_copies as drop

    return drop(docs, **named)
