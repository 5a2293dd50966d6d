"""Kernels search equal queries once and in many tasks; tables for them stay small at the driver."""

import numpy as np
from pyspark import TaskContext

from pathloom.operators import grid, jumps, kernels


def test_equal_queries_are_searched_once_and_spread(spark):
    free = np.ones((9, 9), dtype=np.uint8)
    calls, tasks = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def search(domain, a, b):
        calls.add(1)
        tasks.add(1 << 8 * min(TaskContext.get().partitionId(), 7))
        return kernels.astar(domain, a, b)

    queries = spark.range(0, 400, 1, 1).selectExpr("id as qid", "id % 8 as sx", "id % 8 as sy", "0 as tx", "id % 4 as ty")
    got = {r["qid"]: r["cost"] for r in kernels.run_queries(queries, free, search, paths=False).collect()}
    assert len(got) == 400 and got[3] == got[395 + 8 - 8 * 49] and calls.value == 8
    assert sum(1 for i in range(8) if tasks.value >> 8 * i & 255) > 1
    assert all(got[q] == kernels.astar(free, (q % 8, q % 8), (0, q % 4))[0] for q in range(400))


def test_jump_tables_take_two_bytes_a_cell_and_direction(spark):
    rng = np.random.default_rng(5)
    free = rng.random((11, 13)) > 0.3
    cells = spark.createDataFrame([(x, y, bool(free[y, x])) for y in range(11) for x in range(13)], "x bigint, y bigint, ok boolean")
    domain = jumps.jumps_of(cells, grid.jump_table(cells).unionByName(grid.diagonal_jumps(cells)))
    assert domain.code.nbytes == 2 * 8 * 13 * 15
    ends = [((int(a), int(b)), (int(c), int(d))) for a, b, c, d in rng.integers(-1, 12, (60, 4))]
    for a, b in ends:
        want = kernels.astar(domain.free, a, b)[0]
        assert want == jumps.offline(domain, a, b)[0] == jumps.offline(domain, a, b, through=True)[0] == jumps.online(domain.free, a, b)[0] == jumps.online(domain.free, a, b, through=True)[0]


def test_crowded_location_equals_plain_and_seeks_each_place_once(spark):
    from pyspark.sql import functions as F

    from pathloom.operators import mesh

    corner = lambda x, y: F.struct(F.lit(0.0) + x, F.lit(0.0) + y)
    x, y, w, h = F.col("id") * 7 % 11, F.col("id") * 5 % 9, 1 + F.col("id") % 6, 1 + F.col("id") % 4
    ring = F.array(*(corner(x + a, y + b) for a, b in ((0, 0), (w, 0), (w, h), (0, h)))).cast("array<struct<x:double,y:double>>")
    rings = spark.range(300).select(F.col("id").alias("pid"), ring.alias("ring"))
    points = spark.range(2000).selectExpr("id", "id * 13 % 60 / 4 as x", "id * 7 % 44 / 4 as y")
    found = mesh.locate(points, rings, crowded=True)
    assert sorted(found.collect()) == sorted(mesh.locate(points, rings).collect())
    assert mesh.locate(points, rings.limit(0), crowded=True).where("place = 'outside'").count() == 2000
    assert "keys=[x" in found._jdf.queryExecution().toString()


def test_queries_with_equal_ends_reach_a_search_once(spark):
    from pathloom.operators import workload

    seen = []

    def search(queries):
        seen.extend(queries.collect())
        return queries.selectExpr("qid", "sx + 10 * tx as cost")

    queries = spark.range(60).selectExpr("id as qid", "id % 3 as sx", "0 as sy", "id % 2 as tx", "1 as ty")
    got = {r["qid"]: r["cost"] for r in workload.once(queries, search).collect()}
    assert got == {q: q % 3 + 10 * (q % 2) for q in range(60)} and sorted(r["qid"] for r in seen) == list(range(6))
