"""Sets of queries and of nodes to work on: generated, sampled, sorted, complemented."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import geometry as geo
from pathloom.operators.graph import dense_rank_by
from pathloom.plans.lineage import cut


def generated(cells: DataFrame, solved: DataFrame | None = None, count: int = 1000) -> DataFrame:
    """(qid, sx, sy, tx, ty): free cells from the start of the map paired with those from its end.

    Window k of the pairing shifts the targets by k cells, until ``count``
    queries are made.  With ``solved`` (qid, cost), which the caller's search
    gives, only solvable ones stay, numbered by cost.
    """
    free = dense_rank_by(cells.where("ok").select("x", "y"), [F.col("y"), F.col("x")], "place")
    n = free.count()
    spark = cells.sparkSession
    if not n:
        return spark.createDataFrame([], "qid bigint, sx bigint, sy bigint, tx bigint, ty bigint")
    wanted = spark.range(count).select(F.col("id").alias("qid"), (F.col("id") % n + 1).alias("a"), (F.lit(n) - (F.col("id") + F.floor(F.col("id") / n)) % n).alias("b"))
    out = wanted.join(free.select(F.col("place").alias("a"), F.col("x").alias("sx"), F.col("y").alias("sy")), "a").join(free.select(F.col("place").alias("b"), F.col("x").alias("tx"), F.col("y").alias("ty")), "b").select("qid", "sx", "sy", "tx", "ty")
    if solved is None:
        return out
    kept = dense_rank_by(out.join(solved.where("cost is not null").select("qid", "cost"), "qid"), [F.col("cost"), F.col("qid")], "place")
    return kept.select((F.col("place") - 1).alias("qid"), "sx", "sy", "tx", "ty", "cost")


def sampled(queries: DataFrame, count: int, seed: int, key: str = "qid") -> DataFrame:
    """``count`` of the queries, those whose keys hash lowest with the seed: the same ones on any layout."""
    return queries.orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string"))), key).limit(count)


def by_distance(queries: DataFrame, straight: bool = False) -> DataFrame:
    """Queries (qid, sx, sy, tx, ty) with their empty-grid or straight-line length, numbered from the shortest."""
    ends = [F.col(c) for c in ("sx", "sy", "tx", "ty")]
    length = geo.euclidean(*ends) if straight else geo.octile(*ends)
    return dense_rank_by(queries.withColumn("length", length), [F.col("length"), F.col("qid")], "place")


def complement(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes (column node) that are not chosen."""
    return nodes.select("node").join(chosen.select("node"), "node", "left_anti").distinct()


def slice_of(nodes: DataFrame, parts: int, part: int) -> DataFrame:
    """The share of nodes that one of ``parts`` workers takes, by id."""
    return nodes.where(F.pmod(F.col("node"), F.lit(parts)) == part).select("node")


def once(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``search`` finds (qid and others) for queries (qid, sx, sy, tx, ty), with those of equal ends searched once, under their smallest qid."""
    ends = ["sx", "sy", "tx", "ty"]
    firsts = cut(queries.groupBy(*ends).agg(F.min("qid").alias("first")))
    found = search(firsts.select(F.col("first").alias("qid"), *ends)).withColumnRenamed("qid", "first")
    return queries.join(firsts, ends).select("qid", "first").join(found, "first").drop("first")
