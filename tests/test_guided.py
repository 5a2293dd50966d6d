"""Estimates inside a hierarchy: equal costs, fewer expansions."""

import math
import random

from pathloom.operators import hierarchy
from tests.test_frontier import settled


def test_guided_search_over_a_hierarchy(spark):
    rng = random.Random(6)
    side = 5
    at = {y * side + x: (10 * x, 10 * y) for y in range(side) for x in range(side)}
    rows = []
    for n, (x, y) in at.items():
        for m, (u, v) in at.items():
            if m != n and abs(x - u) <= 10 and abs(y - v) <= 10 and rng.random() < 0.6:
                rows.append((n, m, math.ceil(math.hypot(x - u, y - v)) + rng.choice((0, 0, 1, 5))))
    adj = {}
    for a, b, w in rows:
        adj.setdefault(a, []).append((b, w))
    edges = spark.createDataFrame(rows, "src long, dst long, wt long")
    nodes = spark.createDataFrame([(n, x, y) for n, (x, y) in at.items()], "id long, x long, y long")
    pairs = [(i, rng.randrange(25), rng.randrange(25)) for i in range(8)] + [(90, 5, 5)]
    queries = spark.createDataFrame(pairs, "qid long, source long, target long")
    built, ranks = hierarchy.lazy_contract(edges, percent=30)
    built = hierarchy.cut(built)
    trace, plain = [], []
    got = {r["qid"]: r["cost"] for r in hierarchy.guided_costs(built, ranks, nodes, queries, trace).collect()}
    assert got == {q: settled(adj, s)[0].get(t) for q, s, t in pairs}
    far = nodes.selectExpr("id", "0 as x", "0 as y")
    assert {r["qid"]: r["cost"] for r in hierarchy.guided_costs(built, ranks, far, queries, plain).collect()} == got
    work = [sum(expanded.count() for expanded, _ in t) for t in (trace, plain)]
    assert work[0] < work[1]
