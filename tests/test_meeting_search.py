"""The two-sided search against Dijkstra, on graphs whose shortest paths have many edges."""

from pathloom.operators import graph, search
from pathloom.plans import graph_queries
from tests.oracle import check
from tests.test_search import dijkstra, random_graph


def costs(edges, queries):
    return {r["qid"]: r["cost"] for r in search.meet_in_middle(edges, graph.reverse(edges), queries).collect()}


def test_long_cheap_paths_beat_short_dear_ones(spark):
    rows = [(i, i + 1, 1) for i in range(11)] + [(0, 11, 50), (0, 20, 9), (20, 11, 9)]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, wt bigint")
    queries = spark.createDataFrame([(1, 0, 11), (2, 0, 9), (3, 5, 5), (4, 11, 0), (5, 20, 11), (6, 0, 77)], "qid bigint, source bigint, target bigint")
    assert costs(edges, queries) == {1: 11, 2: 9, 3: 0, 4: None, 5: 9, 6: None}


def test_equals_dijkstra(spark):
    edges, adj = random_graph(spark, 40, 70, 5)
    pairs = [(s, t) for s in (0, 1, 2, 3) for t in range(40)]
    queries = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(pairs)], "qid bigint, source bigint, target bigint")
    want = {s: dijkstra(adj, s) for s in (0, 1, 2, 3)}
    assert costs(edges, queries) == {i: want[s].get(t) for i, (s, t) in enumerate(pairs)}


def test_query_gives_the_costs_of_the_one_sided_search(spark):
    check(spark, graph_queries.QUERIES["p2p_road_bidirectional"], graph_queries.ORACLES["p2p_road"], "sf0.1")
