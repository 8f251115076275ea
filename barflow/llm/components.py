"""Connected components by joins: every node is hung below the least neighbour until only stars remain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, skew_join, stored

#: Links that one partition holds at least, so that few links aren't kept in very many files.
LINKS = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """
    edges: a, b (long). Returns node, root for every node that has an edge; root is the least node of its component.

    Large-star and small-star rounds alternate; each halves paths at least, so rounds grow with the logarithm of the longest path.
    Rounds are kept as tables, not checkpoints, whose plans would carry every round's constraints along. Links never leave the executors; a node with very many neighbours is joined by broadcast of its single row;
    where no node has more than LINKS, a round's joins are plain.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    stars = stored(edges.where("a <> b").select(u, v).distinct(), "links")
    state = _state(stars)
    while state[0]:
        few = lambda df, n=8 + state[0] // LINKS: durable(df.coalesce(n))
        hang = lambda df, least, n=state[0]: skew_join(df, least, ["u"], "degree", how="inner", total=2 * n, least=LINKS)
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree")))
        large = few(hang(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = few(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")))
        small = hang(large, down).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stored(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct().coalesce(8 + state[0] // LINKS), "links")
        before, state = state, _state(stars)
        if before == state:
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
