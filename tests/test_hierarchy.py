"""Hierarchies, labels, hooks and corner graphs on small graphs, against Dijkstra in plain Python."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import clusters, grid, hierarchy, jumps, kernels, labels, search
from pathloom.operators.graph import down_closure


def dijkstra(edges, source):
    out, heap = {}, [(0, source)]
    around = {}
    for a, b, w in edges:
        around.setdefault(a, []).append((b, w))
    while heap:
        g, at = heapq.heappop(heap)
        if at not in out:
            out[at] = g
            for b, w in around.get(at, ()):
                heapq.heappush(heap, (g + w, b))
    return out


@pytest.fixture(scope="module")
def road():
    rng = random.Random(4)
    edges = {(i, i + 1): rng.randrange(1, 9) for i in range(13)} | {(rng.randrange(14), rng.randrange(14)): rng.randrange(1, 9) for _ in range(14)}
    both = {(a, b): w for (a, b), w in edges.items() if a != b}
    both |= {(b, a): w for (a, b), w in list(both.items())}
    return [(a, b, w) for (a, b), w in sorted(both.items())]


def test_lazy_contraction_unpacking_and_upward_trees(spark, road):
    edges = spark.createDataFrame(road, "src bigint, dst bigint, wt bigint")
    weight = {(a, b): w for a, b, w in road}
    for percent in (100, 50):
        built, ranks = hierarchy.lazy_contract(edges, percent=percent)
        rank = {r["node"]: r["rank"] for r in ranks.collect()}
        assert set(rank) == set(range(14))
        rows = built.collect()
        plain = hierarchy.unpack(built, built.select(F.struct("src", "dst").alias("qid"), F.lit(0).alias("pos"), "src", "dst")).collect()
        chains = {}
        for r in sorted(plain, key=lambda r: r["pos"]):
            chains.setdefault(tuple(r["qid"]), []).append((r["src"], r["dst"]))
        for r in rows:
            chain = chains[r["src"], r["dst"]]
            assert chain[0][0] == r["src"] and chain[-1][1] == r["dst"] and all(x[1] == y[0] for x, y in zip(chain, chain[1:]))
            assert sum(weight[c] for c in chain) == r["wt"]
        queries = spark.createDataFrame([(a * 14 + b, a, b) for a in range(0, 14, 3) for b in range(14)], "qid bigint, source bigint, target bigint")
        got = {(r["source"], r["target"]): r["cost"] for r in hierarchy.query_costs(built, ranks, queries, stall=True).collect()}
        assert got == {(a, b): dijkstra(road, a).get(b) for a in range(0, 14, 3) for b in range(14)}
    order = hierarchy.independent_ranks(edges)
    got = {(r["source"], r["target"]): r["cost"] for r in hierarchy.query_costs(hierarchy.contract(edges, order), order, queries).collect()}
    assert got == {(a, b): dijkstra(road, a).get(b) for a in range(0, 14, 3) for b in range(14)}
    tree = hierarchy.upward_tree(built, ranks, spark.createDataFrame([(2,)], "source bigint")).collect()
    assert all(r["g"] >= dijkstra(road, 2)[r["node"]] for r in tree) and {r["node"] for r in tree} >= {2}


def test_hooks_see_rows(spark, road):
    edges = spark.createDataFrame(road, "src bigint, dst bigint, wt bigint")
    start = spark.createDataFrame([(0, 0)], "qid bigint, node bigint")
    counts = {"expand": 0, "generate": 0, "relax": 0}

    def seen(name):
        def hook(rows, *_):
            counts[name] += rows.count()
            return rows

        return hook

    out = search.relax(edges, start, on_expand=seen("expand"), on_generate=seen("generate"), on_relax=seen("relax"))
    assert {r["node"]: r["g"] for r in out.collect()} == dijkstra(road, 0)
    assert counts["expand"] == counts["relax"] + 1 and counts["generate"] >= counts["relax"]
    thin = search.relax(edges, start, on_generate=lambda steps: steps.where("dst <> 1")).collect()
    assert {r["node"]: r["g"] for r in thin} == dijkstra([e for e in road if e[1] != 1], 0)


def test_flags_of_many_parts(spark):
    firsts = spark.createDataFrame([(0, 1, i) for i in range(200)], "source bigint, first bigint, node bigint")
    parts = spark.createDataFrame([(i, i) for i in range(200) if i % 3], "node bigint, part bigint")
    row = labels.arc_flags(firsts, parts).first()
    asked = spark.range(200).select(F.col("id").alias("part"), F.lit(row["flags"]).alias("flags"))
    got = {r["part"]: r["kept"] for r in asked.select("part", labels.keeps_part(F.col("flags"), F.col("part")).alias("kept")).collect()}
    assert got == {i: bool(i % 3) for i in range(200)}


def test_preorder_of_walks(spark, road):
    edges = spark.createDataFrame([*road, (50, 51, 1)], "src bigint, dst bigint, wt bigint")
    for seed in (0, 9):
        rows = sorted(labels.dfs_order(edges, 5, seed).collect(), key=lambda r: r["place"])
        assert [r["place"] for r in rows] == list(range(16)) and rows[0]["node"] == 5 and {r["node"] for r in rows} == {*range(14), 50, 51}
        near = {(a, b) for a, b, _ in road} | {(50, 51)}
        assert all(any((p["node"], r["node"]) in near for p in rows[:i]) or r["node"] in (5, 50) for i, r in enumerate(rows))


def test_closure_labels_hold_what_is_below(spark, road):
    edges = spark.createDataFrame(road, "src bigint, dst bigint, wt bigint")
    ranks = spark.createDataFrame([(i, (i * 5) % 14) for i in range(14)], "node bigint, rank int")
    nodes = spark.createDataFrame([(i, i % 4, i // 4) for i in range(14)], "id bigint, x bigint, y bigint")
    parts = spark.createDataFrame([(i, i % 3) for i in range(14)], "node bigint, part bigint")
    built = hierarchy.contract(edges, ranks)
    below = {}
    for r in down_closure(built.select("src", "dst", "wt"), ranks).collect():
        below.setdefault(r["top"], set()).add(r["node"])
    told = {(r["src"], r["dst"]): r for r in labels.down_labels(built, nodes, parts, ranks).collect()}
    assert set(told) == {(r["src"], r["dst"]) for r in built.collect()}
    for (a, b), r in told.items():
        if (a * 5) % 14 > (b * 5) % 14:
            assert (r["id1"], r["id2"]) == (min(below[b]), max(below[b])) and r["rank2"] == max((n * 5) % 14 for n in below[b])
        else:
            assert r["id1"] <= min(below[b]) and r["id2"] >= max(below[b])


def cells_of(spark, free):
    h, w = free.shape
    return spark.createDataFrame([(x, y, bool(free[y, x])) for y in range(h) for x in range(w)], "x bigint, y bigint, ok boolean").cache()


def test_jump_searches_and_rectangles_equal_astar():
    for seed in range(40):
        rng = random.Random(seed)
        free = (np.random.RandomState(seed).rand(rng.randrange(3, 14), rng.randrange(3, 14)) > rng.choice((0.1, 0.3))).astype(np.uint8)
        area = clusters.Rectangles(free)
        for _ in range(6):
            a, b = ((rng.randrange(free.shape[1]), rng.randrange(free.shape[0])) for _ in range(2))
            want = kernels.astar(free, a, b)[0]
            assert jumps.online(free, a, b)[0] == want and jumps.online(free, a, b, through=True)[0] == want
            assert clusters.rectangle_search(area, a, b)[0] == want


def test_corner_graphs_tables_and_clusters(spark):
    rng = random.Random(2)
    free = (np.random.RandomState(2).rand(13, 15) > 0.25).astype(np.uint8)
    cells, w = cells_of(spark, free), 15
    domain = jumps.jumps_of(cells, grid.jump_table(cells).unionByName(grid.diagonal_jumps(cells)))
    spots = [(int(x), int(y)) for y, x in np.argwhere(free)]
    pairs = [(i, *rng.choice(spots), *rng.choice(spots)) for i in range(25)]
    want = {i: kernels.astar(free, (sx, sy), (tx, ty))[0] for i, sx, sy, tx, ty in pairs}
    for i, sx, sy, tx, ty in pairs:
        assert jumps.offline(domain, (sx, sy), (tx, ty))[0] == want[i] == jumps.offline(domain, (sx, sy), (tx, ty), through=True)[0]
    queries = spark.createDataFrame(pairs, "qid bigint, sx bigint, sy bigint, tx bigint, ty bigint")
    graph = jumps.corner_graph(cells, w)
    costs = lambda df: {r["qid"]: r["cost"] for r in df.collect()}
    assert costs(jumps.corner_costs(graph, queries)) == want
    assert costs(jumps.pruned_corner_costs(graph, cells, queries)) == want
    both = jumps.corner_hierarchy_costs(graph, jumps.corner_hierarchy(graph), queries).collect()
    assert {r["qid"]: r["cost"] for r in both} == {r["qid"]: r["forward"] for r in both} == want
    near = costs(clusters.hierarchical_costs(cells, w, queries, size=5))
    assert all((near[i] is None) == (want[i] is None) and (want[i] is None or near[i] >= want[i]) for i in want)
    step = {(int(a), int(b)): wt for a, b, wt in grid.to_graph(cells, w).collect()}
    for r in clusters.hierarchical_paths(cells, w, queries, size=5).collect():
        assert r["cost"] == near[r["qid"]] == sum(step[e] for e in zip(r["path"], r["path"][1:]))
