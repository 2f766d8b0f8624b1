"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.tables import Workspace


def _toward_least(edges: DataFrame) -> DataFrame:
    """Each ``u`` with the least of itself and its neighbours ``v``."""
    return edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))


def components(links: DataFrame, space: Workspace) -> DataFrame:
    """links ``a, b`` (longs) -> ``node, component`` (the smallest node reachable) for every linked node.

    Large-star and small-star steps alternate until nothing changes, which takes a number of rounds
    logarithmic in the longest chain. A node's neighbours are never put into one row; each round
    is a written table, and the driver sees two sums a round.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = space.save(edges, "links-0")
    before = None
    for step in range(1, 60):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours go to the least of the neighbourhood
        large = (
            both.where("v > u").join(_toward_least(both), "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        ).distinct()
        # small star: smaller neighbours and the node itself go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", "least"), F.struct(F.col("v").alias("u"), "least"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.least").alias("v"))
            .where("u > v")
            .distinct()
        )
        edges = space.save(small, f"links-{step}")
        space.drop(f"links-{step - 1}")
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the links did not come to rest; their components would not be whole")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
