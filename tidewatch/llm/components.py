"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stash


def connected_components(edges: DataFrame, tag: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for every node that an edge links to another one, but for the
    roots themselves; root is the component's least node. `edges` has columns a
    and b of one type; loops and repeats are allowed, an empty table gives an
    empty one.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each is a
    grouped minimum, combined on the map side, and an equi-join. The minima are
    written before they are joined: then both sides of the join come straight
    from an exchange, and AQE can split a hot node. Every round is written to
    the shared folder, so an executor that goes takes no lineage with it.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stash(e, tag)
    seen = None
    for _ in range(rounds):
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)).alias("h")).first()
        if mark == seen or mark["n"] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), tag)
        large = stash(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), tag)
        low = stash(large.groupBy("u").agg(F.min("v").alias("m")), tag)
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stash(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), tag)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
