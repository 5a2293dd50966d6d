"""Connected components over an edge table, by alternating stars.

Large and small stars (Kiveris et al., "Connected Components in MapReduce and
Beyond") are joins and grouped minima; the number of rounds grows with the
logarithm of the graph. Every round is written to the shared folder; the rounds
end when the edges are stars, which is tested exactly.

Edge cases: null ends and self loops are dropped, repeated edges count once,
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.storage import saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    kept = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(least.select("u", F.col("m").alias("v")))


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that hangs on none: then that is its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down")).where("up > 1 or up + down > 1").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node reachable."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, turn = saved(edges, "components-0"), 0
    while not _is_stars(edges):
        turn += 1
        edges = saved(_small_star(_large_star(edges)).distinct(), f"components-{turn}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
