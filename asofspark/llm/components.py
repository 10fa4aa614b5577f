"""Connected components by alternating stars, for links between distinct keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofspark.llm.common import checkpointed

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node reachable.

    A round hangs each node's larger neighbours, then its smaller ones, on its
    smallest neighbour. Rounds grow with the logarithm of the longest chain. The
    minimum of a node is a map-side aggregate and the join back meets one row per
    node, so a node with very many links is split by adaptive execution. Each
    round is a written table; nothing but two sums reaches the driver.
    """
    stars = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(stars)
    if before[0] == 0:
        return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(MAX_ROUNDS):
        stars = checkpointed(_hang_smaller(_hang_larger(stars)))
        now = _state(stars)
        if now == before:
            roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = now
    raise RuntimeError(f"links have not settled after {MAX_ROUNDS} rounds")


def _state(stars: DataFrame) -> tuple:
    row = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def _hang_larger(stars: DataFrame) -> DataFrame:
    both = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _hang_smaller(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("a").agg(F.min("b").alias("m"))
    moved = stars.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
