"""Readers of the text formats, as DataFrames; all parsing runs on the executors.

Formats in which the place of a line counts are read in splits as well: every
split counts its lines, and a running sum over the splits numbers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The label of a blocked cell.
BLOCKED = 2**32 - 1


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, at, value): every line with the split that it is from, and a number that grows within the split."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")


def _running(text: DataFrame, size: Column, joined: bool) -> DataFrame:
    """``text`` with ``before``, the sum of ``size`` over all lines before.

    The sum of a split is added to those of the splits before it, in its file,
    or, ``joined``, in all files by name; only sums of splits meet in one place.
    """
    split = ["file", "start"]
    sums = text.groupBy(*split).agg(F.sum(size).alias("sum"))
    line = (Window.orderBy(*split) if joined else Window.partitionBy("file").orderBy("start")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*split, F.coalesce(F.sum("sum").over(line), F.lit(0)).alias("earlier"))
    inside = F.sum(size).over(Window.partitionBy(*split).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - size
    return text.withColumn("inside", inside).join(sums, split).withColumn("before", (F.col("earlier") + F.col("inside")).cast("bigint")).drop("earlier", "inside")


def lines(spark: SparkSession, path: str, kept: Column | None = None, joined: bool = False) -> DataFrame:
    """(file, line, value) of the lines that ``kept`` tells (all without it), numbered from 0 in each file.

    ``joined`` numbers the lines of a folder as one text, files in the order of
    their names, which is how sorted rows are written.
    """
    text = _split_lines(spark, path)
    return _running(text if kept is None else text.where(kept), F.lit(1), joined).select("file", F.col("before").alias("line"), "value")


def grid_map(spark: SparkSession, path: str) -> DataFrame:
    """(map, x, y, tile) of grid maps: a header in any order, ``map``, then rows of tiles.

    A map with another number of tiles than its height times its width fails.
    """
    text = _running(_split_lines(spark, path), F.lit(1), False).withColumnRenamed("before", "line")
    number = lambda key: F.max(F.regexp_extract("value", rf"^{key}\s+(\d+)", 1).try_cast("int"))
    head = text.where(F.col("value").rlike(r"^(height|width)\s+\d+|^map\s*$")).groupBy("file").agg(
        number("width").alias("w"), number("height").alias("h"), F.min(F.when(F.col("value").rlike(r"^map\s*$"), F.col("line"))).alias("top")
    )
    body = text.join(head, "file").where("line > top").withColumn("row", F.regexp_replace("value", r"\s", ""))
    placed = _running(body, F.length("row"), False)
    sums = placed.groupBy("file").agg(F.sum(F.length("row")).alias("n"))
    # A map without tiles has no rows to fail on.
    known = head.join(sums, "file", "left").select("file", "w", F.when(F.coalesce("n", F.lit(0)) == F.col("w") * F.col("h"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("wrong number of tiles: "), "file"))).alias("good"))
    tiles = placed.drop("w").join(known, "file").where("good").select("file", "w", "before", F.posexplode(F.split("row", "")).alias("i", "tile")).where("tile <> ''")
    at = F.col("before") + F.col("i")
    return tiles.select(F.element_at(F.split("file", "/"), -1).alias("map"), (at % F.col("w")).alias("x"), F.floor(at / F.col("w")).alias("y"), "tile")


def _fields(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.get("f", F.lit(0)) == kind)


def dimacs_graph(spark: SparkSession, path: str) -> DataFrame:
    """edges(src, dst, wt) from lines ``a tail head cost``; other lines are skipped."""
    return _fields(spark, path, "a").select(*(F.get("f", F.lit(i)).cast("bigint").alias(c) for i, c in ((1, "src"), (2, "dst"), (3, "wt"))))


def dimacs_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """nodes(id, x, y) from lines ``v id x y``."""
    return _fields(spark, path, "v").select(*(F.get("f", F.lit(i)).cast("bigint").alias(c) for i, c in ((1, "id"), (2, "x"), (3, "y"))))


def dimacs_queries(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) from lines ``q source [target]``; a missing target asks for all."""
    return _fields(spark, path, "q").select(F.get("f", F.lit(1)).cast("bigint").alias("source"), F.get("f", F.lit(2)).cast("bigint").alias("target"))


def scenario(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, map, width, height, sx, sy, tx, ty, dist, precision) of nine-column rows; short and bad rows are skipped.

    Rows are split at tabs, or at blanks where there are fewer than nine; the
    precision is the number of decimals of the distance.
    """
    line = spark.read.text(path).where(~F.col("value").startswith("version"))
    tabs, blanks = F.split("value", "\t"), F.split(F.trim("value"), r"\s+")
    f = line.select(F.when(F.size(tabs) >= 9, tabs).otherwise(blanks).alias("f")).where(F.size("f") >= 9)
    names = ("bucket", "map", "width", "height", "sx", "sy", "tx", "ty", "dist")
    kinds = {"map": "string", "dist": "double", "sx": "double", "sy": "double", "tx": "double", "ty": "double"}
    out = f.select(*(F.col("f")[i].try_cast(kinds.get(n, "int")).alias(n) for i, n in enumerate(names)), F.length(F.regexp_extract(F.col("f")[8], r"\.(\d+)", 1)).alias("precision"))
    return out.where(" and ".join(f"{n} is not null" for n in names))


def scenario_legacy(spark: SparkSession, path: str) -> DataFrame:
    """(map, sx, sy, tx, ty, dist) of six-column rows."""
    f = spark.read.text(path).where(~F.col("value").startswith("version")).select(F.split(F.trim("value"), r"\s+").alias("f")).where("size(f) = 6")
    names = ("map", "sx", "sy", "tx", "ty", "dist")
    out = f.select(*(F.col("f")[i].try_cast("string" if n == "map" else "double" if n == "dist" else "int").alias(n) for i, n in enumerate(names)))
    return out.where(" and ".join(f"{n} is not null" for n in names))


def numbered_lines(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """(place, value): integers, one a line, in the order of a file or a folder; lines that start otherwise are skipped."""
    found = lines(spark, path, F.col("value").rlike(r"^\s*-?\d"), joined=True)
    return found.select((F.col("line") + first).alias("place"), F.trim("value").cast("bigint").alias("value"))


def node_order(spark: SparkSession, path: str, inverted: bool = False) -> DataFrame:
    """(node, rank) of a contraction order: line i has the node of rank i, or, ``inverted``, the rank of node i."""
    node, rank = ("place", "value") if inverted else ("value", "place")
    return numbered_lines(spark, path).select(F.col(node).alias("node"), F.col(rank).alias("rank"))


def partition_labels(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """(node, part): the part of each node in turn, from node ``first``."""
    return numbered_lines(spark, path, first).select(F.col("place").alias("node"), F.col("value").alias("part"))


def neighbour_lists(spark: SparkSession, path: str) -> DataFrame:
    """(node, value) of a file or folder of neighbour lists: the header as node 0, then one line for every node."""
    return lines(spark, path, joined=True).select(F.col("line").alias("node"), "value")


def mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices(vid, x, y, polygons), polygons(pid, vertices, neighbours)) of one version 2 mesh; a bad mesh fails."""
    from pathloom.sources.meshes import read_mesh

    vertices, polygons = read_mesh(spark, path)
    return vertices.drop("file"), polygons.drop("file")


def labelled_cells(tiles: DataFrame) -> DataFrame:
    """(x, y, v_lab, e_lab) of tiles (x, y, tile): 0 for '.', BLOCKED for others; one for N, S, E, W and waiting each."""
    v_lab = F.when(F.col("tile") == ".", F.lit(0)).otherwise(F.lit(BLOCKED)).cast("bigint")
    return tiles.select("x", "y", v_lab.alias("v_lab"), F.array(*[F.lit(1.0)] * 5).alias("e_lab"))


def results(spark: SparkSession, paths: list[str], schema: T.StructType | str, sep: str = "\t") -> DataFrame:
    """Result files of one schema, with the name of the file each row is from."""
    return spark.read.csv(paths, schema=schema, sep=sep, header=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


