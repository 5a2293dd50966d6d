"""Kernels against each other and relaxation on random grids; readers and writers by round trip."""

import random

import numpy as np
from pyspark.sql import functions as F

from pathloom.operators import grid, kernels, search
from pathloom.sources import readers, writers


def random_grid(seed, w=12, h=10):
    rng = random.Random(seed)
    return np.array([[int(rng.random() > 0.3) for _ in range(w)] for _ in range(h)], dtype=np.uint8)


def test_searches_agree_on_random_grids():
    for seed in range(25):
        free = random_grid(seed)
        cells = [(x, y) for y in range(free.shape[0]) for x in range(free.shape[1]) if free[y, x]]
        rng = random.Random(seed + 100)
        for _ in range(6):
            a, b = rng.choice(cells), rng.choice(cells)
            cost, path = kernels.astar(free, a, b)
            jump, turns = kernels.jump_search(free, a, b)
            assert cost == jump
            if cost is not None:
                assert kernels.octile(abs(a[0] - b[0]), abs(a[1] - b[1])) <= cost <= (kernels.astar(free, a, b, moves=4)[0] or 10**9)
                full = kernels.refine(turns)
                assert full[0] == a and full[-1] == b and all(free[y, x] for x, y in full)
                length, _ = kernels.any_angle(free, a, b)
                assert length is not None and np.hypot(a[0] - b[0], a[1] - b[1]) - 1e-9 <= length <= cost / 100_000 + 1e-4


def test_relaxation_equals_kernel(spark):
    free = random_grid(7)
    cells = spark.createDataFrame([(x, y, bool(free[y, x])) for y in range(10) for x in range(12)], "x bigint, y bigint, ok boolean")
    start = next((x, y) for y in range(10) for x in range(12) if free[y, x])
    edges = grid.to_graph(cells, 12)
    dist = {r["node"]: r["g"] for r in search.single_source(edges, start[1] * 12 + start[0]).collect()}
    queries = spark.createDataFrame([(y * 12 + x, *start, x, y) for y in range(10) for x in range(12)], "qid bigint, sx int, sy int, tx int, ty int")
    got = {r["qid"]: r["cost"] for r in kernels.run_queries(queries, kernels.grid_array(cells), kernels.jump_search).collect()}
    assert {k: int(v) for k, v in got.items() if v is not None} == dist


def test_jump_distances_follow_the_walk(spark):
    free = random_grid(3)
    cells = spark.createDataFrame([(x, y, bool(free[y, x])) for y in range(10) for x in range(12)], "x bigint, y bigint, ok boolean")
    inside = lambda x, y: 0 <= x < 12 and 0 <= y < 10 and bool(free[y, x])
    straight = {}
    for r in grid.jump_table(cells).collect():
        dx, dy, _ = grid.DIRECTIONS[r["dir"]]
        x, y, n = r["x"], r["y"], 0
        while True:
            x, y, n = x + dx, y + dy, n + 1
            if not inside(x, y):
                want = (n - 1, True)
                break
            if any(inside(x + sx, y + sy) and not inside(x + sx - dx, y + sy - dy) for sx, sy in ((dy, dx), (-dy, -dx))):
                want = (n, False)
                break
        assert (r["steps"], r["dead_end"]) == want
        straight[r["x"], r["y"], r["dir"]] = not r["dead_end"]
    for r in grid.diagonal_jumps(cells).collect():
        dx, dy, _ = grid.DIRECTIONS[r["dir"]]
        x, y, n = r["x"], r["y"], 0
        while True:
            if not (inside(x + dx, y + dy) and inside(x + dx, y) and inside(x, y + dy)):
                want = (n, True)
                break
            x, y, n = x + dx, y + dy, n + 1
            if straight[x, y, r["dir"][0]] or straight[x, y, r["dir"][1]]:
                want = (n, False)
                break
        assert (r["steps"], r["dead_end"]) == want, r


def test_formats(spark, tmp_path):
    (tmp_path / "a.map").write_text("type octile\nheight 2\nwidth 3\nmap\n.@.\nTS.\n")
    tiles = {(r["x"], r["y"]): r["tile"] for r in readers.grid_map(spark, f"{tmp_path}/a.map").collect()}
    assert "".join(tiles[x, y] for y in range(2) for x in range(3)) == ".@.TS."
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 7)], "src bigint, dst bigint, wt bigint")
    writers.dimacs_graph(edges, f"{tmp_path}/g")
    assert sorted(readers.dimacs_graph(spark, f"{tmp_path}/g").collect()) == sorted(edges.collect())
    (tmp_path / "q").write_text("c x\nq 1 2\nq 4\n")
    assert [tuple(r) for r in readers.dimacs_queries(spark, f"{tmp_path}/q").collect()] == [(1, 2), (4, None)]
    (tmp_path / "s").write_text("version 1\n0\tm.map\t5\t5\t0\t0\t4\t4\t5.656\nbad row\n1 m 5 5 1 1 2 2 1.4142\n")
    rows = readers.scenario(spark, f"{tmp_path}/s").collect()
    assert [(r["bucket"], r["precision"]) for r in rows] == [(0, 3), (1, 4)]
    (tmp_path / "o").write_text("# order\n7\n3\n5\n")
    assert {r["node"]: r["rank"] for r in readers.node_order(spark, f"{tmp_path}/o").collect()} == {7: 0, 3: 1, 5: 2}
    (tmp_path / "m").write_text("mesh\n2\n4 1\n0 0 2 0 -1\n1 0 2 0 -1\n1 1 2 0 -1\n0 1 2 0 -1\n4 0 1 2 3 -1 -1 -1 -1\n")
    vertices, polygons = readers.mesh(spark, f"{tmp_path}/m")
    assert vertices.count() == 4 and polygons.select(F.size("vertices")).first()[0] == 4


def test_mesh_paths_equal_grid_paths_whatever_the_polygons():
    from pathloom.operators import mesh

    for seed in range(6):
        free = random_grid(seed + 50, 8, 7)
        units = [(x, y, 1, 1) for y in range(7) for x in range(8) if free[y, x]]
        domain = kernels.MeshDomain([[(x, y), (x + w, y), (x + w, y + h), (x, y + h)] for x, y, w, h in units])
        rng = random.Random(seed)
        points = [(x, y) for x, y, _, _ in units]
        for _ in range(5):
            a, b = rng.choice(points), rng.choice(points)
            if a in domain.ambiguous or b in domain.ambiguous:
                continue
            want, got = kernels.any_angle(free, a, b)[0], kernels.mesh_any_angle(domain, a, b)[0]
            assert (want is None) == (got is None) and (want is None or abs(want - got) < 1e-6), (seed, a, b)
        assert len(mesh.best_rectangles(free)) <= len(units)
