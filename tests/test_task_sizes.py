"""Tables whose groups are nearly as many as their rows are grouped by more tasks when they are larger."""

import re

from pyspark.sql import functions as F

from pathloom.operators import grid
from pathloom.plans import graph_queries, shapes


def hashed(df):
    return {int(n) for n in re.findall(r"Exchange hashpartitioning\([^\n]*?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())}


def test_roads_are_grouped_by_more_tasks_when_larger(spark, tmp_path, monkeypatch):
    k = F.col("id")
    spark.range(5000).select((k % 400).alias("l_partkey"), (k * 7 % 50).alias("l_suppkey"), (k % 9).cast("double").alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = {name: sorted(graph_queries.QUERIES[name](spark, str(tmp_path)).collect()) for name in ("undirected_road", "degrees_road")}
    monkeypatch.setattr(shapes, "TASK_ROWS", 100)
    found = {name: graph_queries.QUERIES[name](spark, str(tmp_path)) for name in before}
    assert hashed(found["undirected_road"]) == {50} and 50 in hashed(found["degrees_road"])
    assert {name: sorted(df.collect()) for name, df in found.items()} == before


def test_moves_between_points_are_made_once(spark):
    cells = spark.range(30).selectExpr("id % 6 as x", "floor(id / 6) as y", "id % 4 <> 1 as ok")
    moves = grid.point_steps(cells)
    plan = moves._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
    corners = ((0, 0), (1, 0), (0, 1), (1, 1))
    want = {(r["x"] + a, r["y"] + b, r["x"] + c, r["y"] + d) for r in cells.where("ok").collect() for a, b in corners for c, d in corners if (a, b) != (c, d)}
    assert sorted(tuple(r)[:4] for r in moves.collect()) == sorted(want)
