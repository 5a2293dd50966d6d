"""Time-expanded search: layers of (cell, t) joined to the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.plans.lineage import cut


def reserve(table: DataFrame, more: DataFrame) -> DataFrame:
    """reservations(cell, t) with more of them, each once."""
    return table.select("cell", "t").unionByName(more.select("cell", "t")).distinct()


def unreserve(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("cell", "t"), ["cell", "t"], "left_anti")


def with_constraints(table: DataFrame, more: DataFrame) -> DataFrame:
    """constraints(cell, t, v, e_mask); the first entry for a (cell, t) stays."""
    fresh = more.join(table.select("cell", "t"), ["cell", "t"], "left_anti")
    return table.unionByName(fresh)


def layers(edges: DataFrame, start: int, horizon: int, constraints: DataFrame | None = None, wait: int | None = 1, weighted: bool = False) -> DataFrame:
    """(cell, t, g): cells reachable at each timestep with their least cost.

    ``edges`` has src, dst, wt and, with constraints, bit: the direction's bit
    in ``e_mask``.  A constraint (cell, t, v, e_mask) forbids being at the
    cell at t, and entering it at t over the masked directions.  ``wait`` is the cost of staying,
    None forbids it.  Moves cost 1, or their weight.
    """
    bit = F.col("bit") if "bit" in edges.columns else F.lit(0)
    moves = edges.select("src", "dst", (F.col("wt") if weighted else F.lit(1)).cast("bigint").alias("w"), bit.alias("bit"))
    now = edges.sparkSession.createDataFrame([(start, 0, 0)], "cell bigint, t int, g bigint")
    out = now
    for t in range(1, horizon + 1):
        steps = now.join(moves, F.col("cell") == F.col("src")).select(F.col("dst").alias("cell"), (F.col("g") + F.col("w")).alias("g"), "bit")
        if wait is not None:
            steps = steps.unionByName(now.select("cell", (F.col("g") + wait).alias("g"), F.lit(0).alias("bit")))
        if constraints is not None:
            here = constraints.where(F.col("t") == t).select("cell", "v", "e_mask")
            steps = steps.join(here, "cell", "left").where(F.col("v").isNull() | (~F.col("v") & (F.col("e_mask").bitwiseAND(F.col("bit")) == 0)))
        now = cut(steps.groupBy("cell").agg(F.min("g").alias("g")).select("cell", F.lit(t).alias("t"), "g"))
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out


def arrival(layered: DataFrame, targets: DataFrame) -> DataFrame:
    """(cell, t, g): the cheapest, then earliest arrival at each target cell; nulls where there is none."""
    best = layered.join(targets, "cell").groupBy("cell").agg(F.min(F.struct("g", "t")).alias("m"))
    return targets.join(best, "cell", "left").select("cell", F.col("m.t").alias("t"), F.col("m.g").alias("g"))
