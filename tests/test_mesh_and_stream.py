import random

import numpy as np

from pathloom.operators import mesh
from pathloom.streaming import trace


def test_rectangles_cover_free_cells_once():
    for seed in range(20):
        rng = random.Random(seed)
        free = np.array([[rng.random() > 0.25 for _ in range(11)] for _ in range(9)])
        for build in (mesh.best_rectangles, mesh.grown_rectangles):
            seen = np.zeros_like(free, dtype=int)
            for x, y, w, h in build(free):
                seen[y : y + h, x : x + w] += 1
            assert (seen == free.astype(int)).all()


def test_location_equals_brute_force(spark):
    rings = [(0, [(0, 0), (4, 0), (2, 3)]), (1, [(4, 0), (6, 2), (2, 3)]), (2, [(-3.5, -2), (0, 0), (-1, 4)])]
    polygons = spark.createDataFrame([(p, [(float(x), float(y)) for x, y in r]) for p, r in rings], "pid bigint, ring array<struct<x:double,y:double>>")
    rng = random.Random(1)
    points = [(i, rng.uniform(-5, 7), rng.uniform(-3, 5)) for i in range(300)] + [(300, 2.0, 3.0), (301, 0.0, 0.0)]
    def holds(ring, x, y):
        return all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-8 for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]))
    want = {i: min((p for p, r in rings if holds(r, x, y)), default=None) for i, x, y in points}
    got = mesh.locate(spark.createDataFrame(points, "id bigint, x double, y double"), polygons, 2.0)
    assert {r["id"]: r["pid"] for r in got.collect()} == want
    assert {r["id"]: r["place"] for r in got.where("id >= 300").collect()} == {300: "vertex", 301: "vertex"}
    assert all((r["place"] == "outside") == (r["pid"] is None) for r in got.collect())


def test_polygons_of_all_sizes_are_in_few_bins(spark):
    rng = random.Random(5)
    boxes = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50), 2.0 ** rng.uniform(-3, 9), 2.0 ** rng.uniform(-3, 9)) for i in range(200)]
    rings = spark.createDataFrame([(i, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]) for i, x, y, w, h in boxes], "pid bigint, ring array<struct<x:double,y:double>>")
    assert mesh.binned(rings).groupBy("pid").count().agg({"count": "max"}).first()[0] <= 4
    points = [(i, rng.uniform(-60, 300), rng.uniform(-60, 300)) for i in range(300)]
    got = {r["id"]: r["pid"] for r in mesh.locate(spark.createDataFrame(points, "id bigint, x double, y double"), rings).collect()}
    assert got == {k: min((i for i, x, y, w, h in boxes if x <= px <= x + w and y <= py <= y + h), default=None) for k, px, py in points}
    assert {r["place"] for r in mesh.locate(spark.createDataFrame(points[:2], "id bigint, x double, y double"), rings.limit(0)).collect()} == {"outside"}


def test_stream_counters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(f'{{"qid": {i % 2}, "at": "2024-01-01T00:00:0{i}Z", "type": "expanding", "g": {i}.0}}' for i in range(6)))
    events = trace.read_events(spark, str(tmp_path / "in"))
    stream = trace.counters(events).writeStream.outputMode("complete").format("memory").queryName("counters").start()
    stream.processAllAvailable()
    stream.stop()
    assert sorted((r["qid"], r["n"], r["g"]) for r in spark.sql("select * from counters").collect()) == [(0, 3, 4.0), (1, 3, 5.0)]


def test_location_moves_polygons_to_bins_not_to_the_driver(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["point_location"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [level" in plan and "BroadcastHashJoin [level" not in plan
