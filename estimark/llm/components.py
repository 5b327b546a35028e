"""Connected components of an edge table, without gathering links anywhere.

Alternating large-star and small-star steps: every node hands its larger
neighbours (or its neighbours that are not larger) to the smallest node it
knows.  Both steps are a minimum per node (aggregated before the shuffle) and
an equi-join on the node, so a component that holds a third of all nodes is
spread by the join like any other skewed key.  The edge table is written to
the shared checkpoint folder after every round, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.session import materialize


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that an
    edge names.  Self-loops name a node and link nothing; repeated edges and
    edges in both directions are fine; edges with a null end are ignored; no
    edges give an empty result."""
    nodes = edges.filter(F.col(u).isNotNull() & F.col(v).isNotNull())
    nodes = materialize(nodes.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    now = nodes.filter("u <> v")  # u > v throughout
    seen = _summary(now)
    while seen[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        new = _summary(now)
        if new == seen:
            break
        seen = new
    ends = nodes.select(F.col("u").alias("node")).union(nodes.select("v")).distinct()
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    return (ends.join(stars, ends["node"] == stars["u"], "left")
            .select("node", F.coalesce("component", "node").alias("component")))
