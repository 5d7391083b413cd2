"""Connected components of links between numbered items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in ``links`` (a, b).

    Each round ties a node's larger neighbours to the smallest node it knows
    (large star), then its smaller ones (small star); the number of rounds grows
    with the logarithm of a component's diameter.  Smallest neighbours come from
    partial aggregates and meet the links again in a join, so a node with very
    many links is no group in one task.  Each round is written to the shared
    folder.  Self links and repeated ones are allowed; NULL ends are left out.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL")
    nodes = materialise(edges.selectExpr("explode(array(a, b)) AS node").distinct())
    edges = materialise(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    while True:
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        small = materialise(small.where("u <> v").distinct())
        same = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if small.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == same:
            break
        edges = small
    found = edges.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(found, nodes["node"] == found["u"], "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
