"""Searches against Dijkstra in plain Python on random graphs."""

import heapq
import random

from pyspark.sql import functions as F

from pathloom.operators import graph, hierarchy, search


def dijkstra(adj, source):
    dist, heap = {}, [(0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        if n in dist:
            continue
        dist[n] = d
        for m, w in adj.get(n, ()):
            if m not in dist:
                heapq.heappush(heap, (d + w, m))
    return dist


def random_graph(spark, n, m, seed):
    rng = random.Random(seed)
    rows = {(rng.randrange(n), rng.randrange(n)): rng.randint(1, 9) for _ in range(m)}
    rows = [(a, b, w) for (a, b), w in rows.items() if a != b]
    adj = {}
    for a, b, w in rows:
        adj.setdefault(a, []).append((b, w))
    return spark.createDataFrame(rows, "src bigint, dst bigint, wt bigint").cache(), adj


def test_relax_equals_dijkstra_and_paths_cost_what_they_say(spark):
    edges, adj = random_graph(spark, 30, 90, 1)
    trees = search.relax(edges, spark.createDataFrame([(s, s) for s in (0, 1, 2)], "qid bigint, node bigint"))
    got = {(r["qid"], r["node"]): r["g"] for r in trees.collect()}
    assert got == {(s, n): d for s in (0, 1, 2) for n, d in dijkstra(adj, s).items()}
    weights = {(r["src"], r["dst"]): r["wt"] for r in edges.collect()}
    for r in search.extract_paths(trees, trees.select("qid", F.col("node").alias("target"))).collect():
        assert sum(weights[a, b] for a, b in zip(r["path"], r["path"][1:])) == got[r["qid"], r["target"]]


def test_hierarchy_gives_the_same_costs(spark):
    edges, adj = random_graph(spark, 12, 40, 2)
    nodes = sorted({r[0] for r in edges.select("src").union(edges.select("dst")).distinct().collect()})
    ranks = spark.createDataFrame([(n, (n * 5) % 13) for n in nodes], "node bigint, rank bigint")
    queries = spark.createDataFrame([(i, 0, n) for i, n in enumerate(nodes)], "qid bigint, source bigint, target bigint")
    built = hierarchy.contract(edges, ranks)
    built = built.sparkSession.createDataFrame(built.collect(), built.schema)
    want = dijkstra(adj, 0)
    for form in (hierarchy.query_costs, hierarchy.forward_costs):
        assert {r["target"]: r["cost"] for r in form(built, ranks, queries).collect()} == {n: want.get(n) for n in nodes}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "src bigint, dst bigint, wt bigint")
    assert graph.degrees(none).count() == 0
    assert search.single_source(none, 3).collect()[0]["node"] == 3
