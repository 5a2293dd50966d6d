"""Searches over lattice points and abstract graphs equal relaxation, and need no round for each step of a path."""

import numpy as np
from pyspark.sql import functions as F

from pathloom.operators import clusters, grid, kernels, search


def cells_of(spark, free):
    h, w = free.shape
    return spark.createDataFrame([(x, y, bool(free[y, x])) for y in range(h) for x in range(w)], "x bigint, y bigint, ok boolean").cache()


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_point_search_equals_relaxation(spark):
    free = np.random.default_rng(3).random((7, 9)) > 0.4
    steps = grid.point_steps(cells_of(spark, free))
    edges = steps.select((F.col("y") * 10 + F.col("x")).alias("src"), (F.col("y2") * 10 + F.col("x2")).alias("dst"), "wt", "pinched")
    assert steps.where("pinched").count()
    starts = spark.range(80).select(F.col("id").alias("qid"), F.col("id").alias("node"))
    want = {(r["qid"], r["node"]): r["g"] for r in search.relax(edges, starts, keep=~F.col("pinched") | (F.col("src") == F.col("qid")), preds=False).collect()}
    for a in range(80):
        for b in range(80):
            assert kernels.point_astar(free, (a % 10, a // 10), (b % 10, b // 10))[0] == want.get((a, b)), (a, b)
    assert kernels.point_astar(free, (0, 30), (0, 30))[0] == 0 and kernels.point_astar(free, (0, 30), (0, 0))[0] is None


def test_point_search_has_few_jobs_on_a_long_way(spark, tmp_path):
    from __spark_entry__ import queries

    n = 1600  # a square of 40 by 40 with one way through walls of every second row
    cell = F.col("id")
    walls = (F.floor(cell / 40) % 4 == 1) & (cell % 40 > 0) | (F.floor(cell / 40) % 4 == 3) & (cell % 40 < 39)
    spark.range(n).select(cell.alias("p_partkey"), F.when(walls, 5).otherwise(1).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(40).select(cell.alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    for name in ("point_search", "hierarchical_search"):
        rows, jobs = jobs_of(spark, name, lambda name=name: queries()[name](spark, str(tmp_path)).collect())
        assert len(rows) == 40 and jobs < 60 and any(r["cost"] for r in rows), (name, jobs)


def test_hierarchical_costs_equal_relaxation_over_the_abstract_graph(spark):
    rng = np.random.default_rng(8)
    free = rng.random((17, 23)) > 0.3
    cells, width = cells_of(spark, free), 23
    ends = rng.integers(-1, 24, (40, 4)).tolist()
    queries = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "qid bigint, sx bigint, sy bigint, tx bigint, ty bigint")
    valid = [(i, a, b, c, d) for i, (a, b, c, d) in enumerate(ends) if all(0 <= x < 23 and 0 <= y < 17 and free[y, x] for x, y in ((a, b), (c, d)))]
    nodes = spark.createDataFrame([(y * width + x,) for _, a, b, c, d in valid for x, y in ((a, b), (c, d))], "node bigint")
    edges, _ = clusters.abstract_graph(cells, width, 6, nodes)
    wanted = spark.createDataFrame([(i, b * width + a, d * width + c) for i, a, b, c, d in valid], "qid bigint, source bigint, target bigint")
    want = {r["qid"]: r["cost"] for r in search.point_to_point(edges, wanted).collect()}
    got = {r["qid"]: r["cost"] for r in clusters.hierarchical_costs(cells, width, queries, size=6).collect()}
    assert got == {i: want.get(i) for i in range(40)} and any(c for c in got.values())
