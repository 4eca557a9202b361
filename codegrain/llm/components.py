"""Connected components by alternating large-star and small-star rounds.

Every round is a pre-aggregated minimum and a join on the same key; lineage is
cut by a written table, and only a count and a checksum reach the driver.

Defined results: links with a null end are ignored, as are links of a node with
itself; repeated links count once; extra columns are ignored; no links give no
rows; a chain of any length settles in a number of rounds that grows with its
length's logarithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.llm.common import cut, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Both directions of edges (u, v), or only those to smaller neighbours; each neighbour links to the least one."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) of an orderable type -> (node, root): root is the least node reachable; only nodes with an edge appear."""
    now = cut(edges.select("u", "v").filter("u <> v").distinct(), "edges")  # a null end is no link
    seen = None
    for _ in range(rounds):
        now = cut(_star(_star(now, True), False), "stars")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or state[0] == 0:
            break
        seen = state
        release(now.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
