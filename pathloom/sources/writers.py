"""Writers of the text formats; every one is a distributed write of a projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def results(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.csv(path, sep=sep, header=True)


def results_by_owner(df: DataFrame, path: str) -> None:
    df.write.partitionBy("owner").csv(path, header=True)


def paths(df: DataFrame, path: str) -> None:
    """``path qid; (x, y) ...`` lines from (qid, path) with points as structs of x and y."""
    points = F.array_join(F.transform("path", lambda p: F.concat(F.lit("("), p["x"].cast("string"), F.lit(", "), p["y"].cast("string"), F.lit(")"))), " ")
    df.select(F.concat(F.lit("path "), F.col("qid").cast("string"), F.lit("; "), points).alias("value")).write.text(path)


def dimacs_graph(edges: DataFrame, path: str, low: int | None = None, high: int | None = None) -> None:
    """Arc lines; only those whose tail lies in [low, high) if given."""
    out = edges if low is None else edges.where((F.col("src") >= low) & (F.col("src") < high))
    out.select(F.concat_ws(" ", F.lit("a"), "src", "dst", "wt").alias("value")).write.text(path)


def dimacs_coordinates(nodes: DataFrame, path: str) -> None:
    nodes.select(F.concat_ws(" ", F.lit("v"), "id", "x", "y").alias("value")).write.text(path)


def metis(pairs: DataFrame, path: str) -> None:
    """One line per node 1..n with its neighbours, in order, after a header line; ``pairs`` has a, b. Nodes without a neighbour have an empty line."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = pairs.agg(F.coalesce(F.greatest(F.max("a"), F.max("b")), F.lit(0)).cast("bigint").alias("n"), F.countDistinct(F.least("a", "b"), F.greatest("a", "b")).alias("m")).first()
    held = both.groupBy("a").agg(F.array_join(F.transform(F.sort_array(F.collect_set("b")), lambda b: b.cast("string")), " ").alias("value"))
    spark = pairs.sparkSession
    lines = spark.range(1, size["n"] + 1).select(F.col("id").alias("a")).join(held, "a", "left").select("a", F.coalesce("value", F.lit("")).alias("value"))
    head = spark.createDataFrame([(0, f"{size['n']} {size['m']}")], "a bigint, value string")
    head.unionByName(lines).orderBy("a").select("value").write.text(path)


def scenario(df: DataFrame, path: str) -> None:
    """Nine-column rows, the bucket included."""
    df.select(F.concat_ws("\t", "bucket", "map", "width", "height", "sx", "sy", "tx", "ty", "dist").alias("value")).write.text(path)


def node_order(ranks: DataFrame, path: str) -> None:
    ranks.orderBy("rank").select(F.col("node").cast("string").alias("value")).write.text(path)


def trace(events: DataFrame, path: str) -> None:
    """Search events (qid, seq, type, node, parent, g, f) as JSON lines."""
    events.write.json(path)
