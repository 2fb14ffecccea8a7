"""Connected components of a table of links, as joins and aggregates (the alternating star contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetables.llm.common import Scratch, join_groups

#: Links that one task may meet at the centre of a star; only tables with more need their large stars dealt.
FEW = 200_000


def _nearest(edges: DataFrame, scratch: Scratch | None) -> DataFrame:
    """Each edge (u, v) with m, the smallest of u and all its neighbours; with ``scratch``, a large star has its edges in many tasks."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "least").alias("m"), "n")
    if scratch is None:
        return edges.join(least.hint("merge"), "u").select("u", "v", "m")
    return join_groups(edges, scratch.written(least, "star-centres"), ["u"], "n").select("u", "v", "m")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (smallest node of its component) from links (a, b); nodes without a link are left out.

    Links may repeat, point either way or at themselves, and be none.  Each round replaces edges by edges to the smallest neighbour;
    the rounds needed grow with the logarithm of the longest path.  Only counts come to the driver.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.written(edges, "star")
    of = scratch if edges.count() > FEW else None
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both, of).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _nearest(scratch.written(large, "star") if of else large, of)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = scratch.written(small, "star")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
