"""The frontier engine: its plan, spread sources, delta steps, bounds, and paths by doubling."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import search


def settled(adj, source, most=None):
    """(cost by node, nodes in the order of (cost, node))."""
    dist, heap, order = {}, [(0, source)], []
    while heap and (most is None or len(order) < most):
        d, n = heapq.heappop(heap)
        if n in dist:
            continue
        dist[n] = d
        order.append(n)
        for m, w in adj.get(n, ()):
            if m not in dist:
                heapq.heappush(heap, (d + w, m))
    return dist, order


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(8)
    rows = {(rng.randrange(40), rng.randrange(40)): rng.randint(0, 9) for _ in range(130)} | {(0, m): rng.randint(1, 30) for m in range(1, 40)}
    rows = [(a, b, w) for (a, b), w in rows.items() if a != b]
    adj = {}
    for a, b, w in rows:
        adj.setdefault(a, []).append((b, w))
    return spark.createDataFrame(rows, "src long, dst long, wt long"), adj


def test_a_round_moves_only_the_frontier_and_its_steps(spark, graph, monkeypatch):
    """No shuffle reads the edges or the state; a source with many edges lies in several buckets, with equal results."""
    plans = []
    dealt = search.dealt

    def seen(df, *keys, spread=True):
        if not spread:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return dealt(df, *keys, spread=spread)

    monkeypatch.setattr(search, "dealt", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    edges, adj = graph
    sources = spark.createDataFrame([(s, s) for s in (0, 7)], "qid long, node long")
    try:
        for most in (search.MOST_EDGES, 10):
            net = search.Network.of(edges, most)
            assert (net.heavy is None) == (most > 10)
            got = {(r["qid"], r["node"]): r["g"] for r in search.relax(net, sources, preds=False).collect()}
            assert got == {(s, n): d for s in (0, 7) for n, d in settled(adj, s)[0].items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first = plans[1]
    # Of a round's plan: the frontier goes to its edges, steps go to the state.
    assert first.count("Exchange hashpartitioning") == 2 and first.count("Bucketed: true") >= 3


def test_delta_steps_and_bounds(spark, graph):
    edges, adj = graph
    net = search.Network.of(edges)
    sources = spark.createDataFrame([(s, s) for s in (0, 7, 39)], "qid long, node long")
    traces = {}
    for delta in (None, 3):
        trace = traces[delta] = []
        got = {(r["qid"], r["node"]): r["g"] for r in search.relax(net, sources, delta=delta, trace=trace, preds=False).collect()}
        assert got == {(s, n): d for s in (0, 7, 39) for n, d in settled(adj, s)[0].items()}
    made = {k: search.counters(net, t).agg(F.sum("generated")).first()[0] for k, t in traces.items()}
    assert made[3] < made[None]
    for most in (1, 6):
        rows = search.bounded(net, sources, most, delta=3).collect()
        for s in (0, 7, 39):
            dist, order = settled(adj, s, most)
            want = {n: (dist[n], True) for n in order}
            for n in order:
                for m, w in adj.get(n, ()):
                    if m not in dist and dist[n] + w < want.get(m, (1e9,))[0]:
                        want[m] = (dist[n] + w, False)
            assert {r["node"]: (r["g"], r["expanded"]) for r in rows if r["qid"] == s} == want


def test_a_long_path_in_few_rounds(spark, monkeypatch):
    n, cuts = 10_000, []
    cut = search.cut
    monkeypatch.setattr(search, "cut", lambda df: cuts.append(1) or cut(df))
    tree = spark.range(n + 1).select(F.lit(5).cast("long").alias("qid"), F.col("id").alias("node"), F.col("id").alias("g"), F.when(F.col("id") > 0, F.col("id") - 1).alias("pred"))
    ends = spark.createDataFrame([(5, n), (5, 0), (5, 3), (6, 1), (5, n + 9)], "qid long, target long")
    got = {(r["qid"], r["target"]): r["path"] for r in search.extract_paths(tree, ends).collect()}
    assert got == {(5, t): list(range(t + 1)) for t in (n, 0, 3)}
    assert len(cuts) <= 2 * 16
