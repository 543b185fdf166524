"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import staged, unstage


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        """True if the two were apart."""
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _locally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a partition as stars: at most one row per node."""
    for pdf in frames:
        forest = Forest()
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            forest.join(a, b)
        pairs = [(x, forest.root(x)) for x in forest.up]  # the root is the smaller one
        yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")


def _stars(edges: DataFrame) -> bool:
    """Whether distinct edges (a, b) with b < a are stars already: each a hangs on one b, and no b hangs on another."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every end of ``links`` (a, b long).

    Each round hangs a node's larger neighbours on its smallest one (large star), then its smaller ones (small star);
    both need only a minimum per node, which is combined before the shuffle, and a join that adaptive execution can
    split.  Links shrink to stars in logarithmically many rounds.  Loops and repeated links do no harm; without links
    there are no rows.
    """
    edges = staged(links.where("a <> b").select("a", "b").mapInPandas(_locally, "a long, b long").where("a <> b").distinct())
    while not _stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("x")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), "m")
        joined = down.join(least, F.col("a") == F.col("x"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, edges = edges, staged(small)
        unstage(before, large)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
