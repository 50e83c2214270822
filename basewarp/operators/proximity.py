"""Proximity: pairs of sites of two patterns at a distance, as a bucketed range join.

Sites are dealt to buckets as wide as the greatest distance; a site meets its own and the two
neighbouring buckets, so the range join is an equi-join and no sequence's sites are crossed
with each other.

The open-ended "greater than" searches have as many pairs as a sequence's sites squared.  Their pairs are made by
blocks: a sequence is cut into at most BLOCKS stretches, sites meet by (sequence, stretch of a, stretch of b), and
stretches that lie too near are never paired, so a long sequence is dealt over thousands of keys.  far_counts needs no pairs: how many
sites lie beyond a distance is a difference of ranks.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stretches of a sequence at most, and bases of one at least.
BLOCKS, STRETCH = 64, 1 << 16


@dataclasses.dataclass(frozen=True)
class Proximity:
    """direction: 0 either way, -1 a upstream of b, 1 a downstream.  kind: l less than lo, g more than lo, r lo to hi."""

    a: str
    b: str
    direction: int = 0
    kind: str = "l"
    lo: int = 0
    hi: int = 0

    @property
    def number(self) -> int:
        """The search type, 0 to 8."""
        return {0: 0, -1: 3, 1: 6}[self.direction] + "lgr".index(self.kind)


def parse(text: str) -> Proximity:
    """``A,[+|-][l|g]lo[-hi],B``: - A upstream, + A downstream; l (or nothing) less, g greater, lo-hi a range."""
    a, distance, b = [x.strip() for x in text.split(",")]
    m = re.fullmatch(r"([+-]?)([lg]?)(\d+)(?:-(\d+))?", distance)
    if not m:
        raise ValueError(f"distance {distance!r} can't be read")
    sign, kind, lo, hi = m.groups()
    if hi and kind:
        raise ValueError("a range takes neither l nor g")
    if hi and int(hi) < int(lo):
        raise ValueError("the range ends before it begins")
    return Proximity(a, b, {"": 0, "-": -1, "+": 1}[sign], "r" if hi else kind or "l", int(lo), int(hi or 0))


def _holds(spec: Proximity) -> Column:
    d = F.col("site_b") - F.col("site_a")
    d = F.abs(d) if spec.direction == 0 else d if spec.direction == -1 else -d
    if spec.kind == "g":
        return d > spec.lo
    if spec.kind == "r":
        return (d >= spec.lo) & (d <= spec.hi)
    return (d < spec.lo) & (d > 0) if spec.direction else d < spec.lo


def _ends(sites: DataFrame, spec: Proximity) -> tuple[DataFrame, DataFrame]:
    """The distinct sites of both patterns: site_a, and site_b."""
    pick = lambda name, out: sites.where(F.lower("pat") == name.lower()).select("seq_id", "seq_len", F.col("site").alias(out)).distinct()
    return pick(spec.a, "site_a"), pick(spec.b, "site_b")


def _far_pairs(a: DataFrame, b: DataFrame, spec: Proximity) -> DataFrame:
    wide = F.greatest(F.lit(STRETCH), F.ceil(F.col("seq_len") / F.lit(BLOCKS)))
    k = lambda x: F.floor(x / wide).cast("long")
    last = k(F.col("seq_len"))
    above = lambda c: F.sequence(k(F.col(c) + spec.lo), last)
    below = lambda c: F.sequence(F.lit(0).cast("long"), k(F.col(c) - spec.lo))
    up, down = lambda c: F.when(F.col(c) + spec.lo <= F.col("seq_len"), above(c)), lambda c: F.when(F.col(c) > spec.lo, below(c))
    # -1: b lies above a; 1: below; 0: either, told apart by the side.
    parts = []
    for side in (-1, 1) if spec.direction == 0 else (spec.direction,):
        of_b, of_a = (up, down) if side == -1 else (down, up)
        left = a.select("seq_id", "site_a", k(F.col("site_a")).alias("_ka"), F.explode(of_b("site_a")).alias("_kb"))
        right = b.select("seq_id", "site_b", k(F.col("site_b")).alias("_kb"), F.explode(of_a("site_b")).alias("_ka"))
        d = (F.col("site_b") - F.col("site_a")) * -side
        parts.append(left.join(right, ["seq_id", "_ka", "_kb"]).where(d > spec.lo).select("seq_id", "site_a", "site_b"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def near(sites: DataFrame, spec: Proximity | str) -> DataFrame:
    """seq_id, site_a, site_b, distance (b - a) of every pair; equal sites of one pattern are no pair."""
    spec = parse(spec) if isinstance(spec, str) else spec
    a, b = _ends(sites, spec)
    reach = {"l": spec.lo, "r": spec.hi}.get(spec.kind)
    if spec.kind == "g":
        pairs = _far_pairs(a, b, spec)
    else:
        reach = max(1, reach)  # equal sites have distance 0
        bucket = lambda c: F.floor(F.col(c) / F.lit(reach)).cast("long")
        b = b.select("seq_id", "site_b", bucket("site_b").alias("bucket"))
        a = a.select("seq_id", "site_a", F.explode(F.array(*[bucket("site_a") + k for k in (-1, 0, 1)])).alias("bucket"))
        pairs = a.join(b, ["seq_id", "bucket"]).drop("bucket").where(_holds(spec))
    if spec.a.lower() == spec.b.lower():
        pairs = pairs.where("site_a <> site_b")
    return pairs.select("seq_id", "site_a", "site_b", (F.col("site_b") - F.col("site_a")).alias("distance"))


def far_counts(sites: DataFrame, spec: Proximity | str) -> DataFrame:
    """seq_id, site_a, n: how many pairs near() has for each site of a, for a "greater than" search, without making them.

    How many sites of b lie at or below a coordinate is a rank: of those in its stretch a running count, of those in
    stretches before a prefix sum over the stretches' counts.  Sites without such a pair have no row.
    """
    spec = parse(spec) if isinstance(spec, str) else spec
    if spec.kind != "g":
        raise ValueError("ranks count what lies beyond a distance")
    a, b = _ends(sites, spec)
    sides = (-1, 1) if spec.direction == 0 else (spec.direction,)
    # above: those beyond a + lo are all less those up to it; below: those up to a - lo - 1.
    asked = [a.select("seq_id", "site_a", F.lit(side).alias("side"), (F.col("site_a") + spec.lo if side == -1 else F.col("site_a") - spec.lo - 1).alias("at")) for side in sides]
    points = b.select("seq_id", F.lit(None).cast("long").alias("site_a"), F.lit(0).alias("side"), F.col("site_b").alias("at"))
    for x in asked:
        points = points.unionByName(x)
    points = points.withColumn("k", F.floor(F.col("at") / F.lit(STRETCH)))
    own = (F.col("side") == 0).cast("long")
    by = Window.partitionBy("seq_id")
    stretches = points.groupBy("seq_id", "k").agg(F.sum(own).alias("own"))
    stretches = stretches.select("seq_id", "k", (F.sum("own").over(by.orderBy("k")) - F.col("own")).alias("before"), F.sum("own").over(by).alias("total"))
    ranked = points.withColumn("inside", F.sum(own).over(Window.partitionBy("seq_id", "k").orderBy("at"))).where("side <> 0").join(stretches, ["seq_id", "k"])
    rank = F.col("before") + F.col("inside")
    return ranked.groupBy("seq_id", "site_a").agg(F.sum(F.when(F.col("side") == -1, F.col("total") - rank).otherwise(rank)).alias("n")).where("n > 0")
