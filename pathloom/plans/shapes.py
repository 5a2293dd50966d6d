"""Graphs, grids, queries and result tables derived from the star schema, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Node id of supplier 0 in the road graph.
SUPPLIERS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a large table that one task groups, about.
TASK_ROWS = 1_000_000


def tasks(rows: DataFrame) -> int:
    """Tasks for grouping a table whose groups are nearly as many as its rows: more for more rows, so that none holds more."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS)


def road(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers, linked both ways by the least quantity of a line between them."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIERS).alias("dst"), F.col("l_quantity").cast("bigint").alias("wt"))
    lines = lines.repartition(tasks(lines), "src", "dst").groupBy("src", "dst").agg(F.min("wt").alias("wt"))
    # Both directions come from one pass over the groups.
    ways = F.explode(F.array(F.struct("src", "dst", "wt"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "wt")))
    return lines.select(ways.alias("e")).select("e.*")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, linked from supplier's to customer's; weight from the number of lines, 1 to 97.

    Orders learn their nation first, so that of the large tables lines move once, to their orders.
    """
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("dst"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("src"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customers, "o_custkey").select("l_orderkey", "dst")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(suppliers, "l_suppkey").select("l_orderkey", "src")
    met = lines.join(orders, "l_orderkey").where("src <> dst")
    return met.groupBy("src", "dst").agg((F.count(F.lit(1)) % 97 + 1).alias("wt"))


def nation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, part) of nations on a 5-wide grid; the part is the region."""
    n = F.col("n_nationkey").cast("bigint")
    return table(spark, sf_dir, "nation").select(n.alias("id"), (n % 5).alias("x"), F.floor(n / 5).cast("bigint").alias("y"), F.col("n_regionkey").cast("bigint").alias("part"))


def grid_width(spark: SparkSession, sf_dir: str) -> int:
    """Side of the square that holds all parts."""
    n = table(spark, sf_dir, "part").count()
    side = int(n**0.5)
    return side + (side * side < n)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells(x, y, ok, tile, cost) with one cell per part."""
    w = grid_width(spark, sf_dir)
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (key % w).alias("x"), F.floor(key / w).cast("bigint").alias("y"), (F.col("p_size") % 5 != 0).alias("ok"),
        F.when(F.col("p_size") % 5 != 0, F.substring(F.lit(".GMs"), (F.col("p_size") % 4).cast("int") + 1, 1)).otherwise("@").alias("tile"),
        (F.col("p_size") % 4 + 1).cast("bigint").alias("cost"),
    )


ROAD = f"""lines AS (SELECT l_partkey AS src, {SUPPLIERS} + l_suppkey AS dst, MIN(CAST(l_quantity AS BIGINT)) AS wt FROM lineitem GROUP BY 1, 2),
e AS (SELECT src, dst, wt FROM lines UNION ALL SELECT dst, src, wt FROM lines)"""

TRADE = """t AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, count(*) % 97 + 1 AS wt
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""

NATIONS = "nn AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey % 5 AS BIGINT) AS x, CAST(n_nationkey // 5 AS BIGINT) AS y, CAST(n_regionkey AS BIGINT) AS part FROM nation)"

GRID = """w AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM part),
c AS (SELECT p_partkey % w AS x, p_partkey // w AS y, p_size % 5 <> 0 AS ok,
  CASE WHEN p_size % 5 <> 0 THEN substr('.GMs', CAST(p_size % 4 AS INT) + 1, 1) ELSE '@' END AS tile, CAST(p_size % 4 + 1 AS BIGINT) AS cost FROM part, w),
f AS (SELECT x, y FROM c WHERE ok)"""


def rounds(edges: str, start: str, k: int, keys: str = "qid, node") -> str:
    """A chain of CTEs r0..rk: least costs over at most k edges. ``start`` selects qid, node, g."""
    parts = [f"r0 AS ({start})"]
    parts += [
        f"r{i} AS (SELECT qid, node, MIN(g) AS g FROM (SELECT * FROM r{i - 1} UNION ALL SELECT qid, dst, g + wt FROM r{i - 1} JOIN {edges} ON src = node) GROUP BY ALL)"
        for i in range(1, k + 1)
    ]
    return ",\n".join(parts)
