"""Connected components of an edge table by alternating large-star and small-star rounds.

Nodes are longs.  Partitions first contract their own edges with union-find.  In each round
every node's least neighbour comes from a grouped minimum (summed on the map side, so a
hub is no hot group), and joining it back rewires the edges; AQE splits a hub's rows in
that join.  Edges go to a written table each round, so lineage stays short and a lost
executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, shuffles_dropped, written


class Forest:
    """Union-find with the least member as root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while up.get(x, x) != top and x != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


def _contract(frames):
    """Edges of a partition as stars around each local component's least node."""
    for f in frames:
        forest = Forest()
        for a, b in zip(f["a"].tolist(), f["b"].tolist()):
            forest.join(a, b)
        nodes = list(forest.up)
        yield pd.DataFrame({"a": np.array([forest.root(x) for x in nodes], dtype=np.int64), "b": np.array(nodes, dtype=np.int64)})


def _large(edges: DataFrame) -> DataFrame:
    """Neighbours above a node go to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it go to the least of these."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b")


def _stars(edges: DataFrame) -> bool:
    """Whether no node is a leaf twice, or both a leaf and a centre: then nothing changes any more."""
    ends = edges.select(F.col("a").alias("x"), F.lit(0).alias("leaf")).unionByName(edges.select(F.col("b").alias("x"), F.lit(1).alias("leaf")))
    wrong = ends.groupBy("x").agg(F.sum("leaf").alias("as_leaf"), F.min("leaf").alias("least")).where("as_leaf > 1 OR as_leaf = 1 AND least = 0")
    with shuffles_dropped(edges.sparkSession):
        return wrong.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the component's least node.  edges: a, b (longs, a <> b)."""
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    now = written(ordered.mapInPandas(_contract, "a long, b long").distinct(), "edges")
    while not _stars(now):
        new = written(_small(_large(now).distinct()).distinct(), "edges")
        dropped(now)
        now = new
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
