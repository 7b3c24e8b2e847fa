"""Groups of what is alike among members of bands: sketches rule pairs out in the join, few centres connect most of a group. Native."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, join_by_group
from .graph import components

#: 64-bit words of a sketch; centres that a band's other members are compared with in a round; rows of a band that one place of a join takes.
WORDS, CENTRES, PLACE = 16, 8, 4096
#: Comparisons of sketches that a row outside its band's commonest root may cost, on average, before centres are tried; a round of centres costs about as much.
EACH = 128
#: Rows of 24 bytes that may be broadcast.
FEW = 200_000
#: Least similarity, as a fraction.
ALIKE = (4, 5)


def _may_be_alike(x: str, y: str) -> Column:
    """False only where the sketches of two rows prove that the lines aren't alike."""
    up, down = ALIKE
    apart = reduce(add, [F.bit_count(F.col(f"{x}.w{w}").bitwiseXOR(F.col(f"{y}.w{w}"))) for w in range(WORDS)])
    return (up + down) * apart <= (down - up) * (F.col(f"{x}.size") + F.col(f"{y}.size"))


def members_of(named: DataFrame, bands: int) -> tuple[Stage, Stage]:
    """``band, n, first, nid`` for what shares a band with more than one other, of ``nid, bands``; and pairs ``a, b`` that share a band with no other.

    Two in a band are known by the least and the greatest; only larger bands are joined to their members.
    """
    spread = named.select("nid", F.explode("bands").alias("band"))
    groups = Stage(spread.groupBy("band").agg(F.min("nid").alias("first"), F.max("nid").alias("last"), F.count("*").alias("n")).filter("n > 1"), "groups")
    two = Stage(groups.df.filter("n = 2").select(F.col("last").alias("a"), F.col("first").alias("b")).distinct(), "two")
    large = groups.df.filter("n > 2").select("band", "n", "first")
    met = spread.join(F.broadcast(large), "band") if large.count() <= FEW else join_by_group(spread, large, "band", "n", named.count() * bands)
    held = Stage(met.select("band", "n", "first", "nid"), "held")
    groups.drop()
    return held, two


def _compared(some: DataFrame, others: DataFrame, verify: Callable[[DataFrame], DataFrame], more: DataFrame | None = None) -> Stage:
    """Links ``a, b`` between roots: of rows of ``some`` and ``others`` of one band and different roots, those that are alike.

    Both have ``band, nid, root, size, w0..``, ``some`` also ``n``, a band's rows, by which crowded bands are dealt over many places.
    ``more``: pairs ``a, b, ra, rb`` to verify as well.
    """
    places = F.ceil(F.col("n") / PLACE).cast("int")
    x = some.withColumn("place", F.pmod(F.xxhash64("nid"), places).cast("int")).alias("x")
    y = others.withColumn("place", F.explode(F.sequence(F.lit(0), places - 1))).alias("y")
    near = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.place") == F.col("y.place")) & (F.col("x.root") != F.col("y.root")) & _may_be_alike("x", "y"))
    a, b = F.struct("x.nid", "x.root"), F.struct("y.nid", "y.root")
    found = near.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).select(F.col("a.nid").alias("a"), F.col("b.nid").alias("b"), F.col("a.root").alias("ra"), F.col("b.root").alias("rb"))
    pairs = Stage((found if more is None else found.unionByName(more)).distinct(), "pairs")
    links = Stage(verify(pairs.df).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "alike")
    pairs.drop()
    return links


class Grouping:
    """Members of bands ``band, n, nid, size, w0.., root``, and the root of each member that isn't its own."""

    def __init__(self, members: Stage):
        self.members, self.costly = members, True
        self.roots = Stage(members.df.select(F.col("nid").alias("node"), "root").limit(0), "roots")

    def settle(self, links: Stage) -> Stage:
        """Take in links between roots, in ``roots`` only: ``node, root`` of the roots that went."""
        moved = Stage(components(links.df), "moved")
        links.drop()
        to = moved.df.select(F.col("node").alias("root"), F.col("root").alias("to"))
        old = self.roots.df.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots, was = Stage(old.unionByName(moved.df), "roots"), self.roots
        self.roots = roots
        was.drop()
        return moved

    def merge(self, links: Stage) -> bool:
        """Take in links between roots; then only bands that still hold several roots stay.

        ``most`` is a band's commonest root. Whether at least a tenth as many roots went as rows are still outside it. ``costly``: whether
        these are too many to compare each with all of its band, or a band is crowded.
        """
        moved = self.settle(links)
        to = moved.df.select(F.col("node").alias("root"), F.col("root").alias("to"))
        own, had = self.members.df.drop("most"), self.members
        named = own.select("band", "root").join(to, "root", "left").select("band", F.coalesce("to", "root").alias("root"))
        each = named.groupBy("band", "root").agg(F.count("*").alias("own"))
        bands = Stage(each.groupBy("band").agg(F.max(F.struct("own", "root")).alias("top"), F.count("*").alias("roots"), F.sum("own").alias("rows")).filter("roots > 1").select("band", F.col("top.root").alias("most"), (F.col("rows") - F.col("top.own")).alias("apart"), "rows"), "open")
        self.members = Stage(own.join(bands.df.select("band", "most"), "band").join(to, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to"), "members")
        apart, each, most = bands.df.agg(F.coalesce(F.sum("apart"), F.lit(0)), F.coalesce(F.sum(F.col("apart").cast("double") * F.col("rows")), F.lit(0.0)), F.coalesce(F.max("rows"), F.lit(0))).first()
        went = 10 * moved.count() >= apart
        self.costly = each > EACH * apart or most > PLACE
        for stage in (had, moved, bands):
            stage.drop()
        return went

    def centres(self, nth: int) -> DataFrame:
        """Up to ``CENTRES`` members of each band's commonest root, others in each round."""
        fields = [c for c in self.members.df.columns if c not in ("band", "most")]
        order = F.xxhash64(F.lit(nth), "nid")
        return self.members.df.filter("root = most").groupBy("band", F.pmod(order, F.lit(CENTRES)).alias("slot")).agg(F.min_by(F.struct(*fields), order).alias("c")).select("band", "c.*")

    def apart(self) -> DataFrame:
        return self.members.df.filter("root <> most")


def roots_of(members: Stage, two: Stage, verify: Callable[[DataFrame], DataFrame]) -> Stage:
    """``node, root`` of what is connected by alike pairs that share a band: pairs ``two``, and members ``band, n, first, nid, size, w0.., root``.

    ``verify`` tells which pairs ``a, b, ..`` are alike; joins of members rule out, by sketch, pairs that can't be. First each member is
    compared with its band's first one. Of bands that still hold several roots, all members outside the commonest root are compared
    with some of that root's, in rounds, as long as these connect much and bands are large; then with all members of the band that have another root.
    So most of a large group is connected by few pairs, and no pair of a band is left out. A band's members that no
    pair connects are compared by sketch with all of the band, dealt over many tasks. ``members`` and ``two`` are deleted.
    """
    found, nth = Grouping(members), 0
    pairs = two.df.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb"))
    found.merge(_compared(members.df.filter("nid <> first"), members.df.filter("nid = first"), verify, pairs))
    two.drop()
    while found.costly and found.merge(_compared(found.apart(), found.centres(nth), verify)):
        nth += 1
    found.settle(_compared(found.members.df, found.apart(), verify)).drop()
    found.members.drop()
    return found.roots
