"""First moves inside the forward search of a hierarchy."""

from pathloom.operators import hierarchy, labels


def test_moves_of_states_lead_along_shortest_paths(spark):
    edges = spark.createDataFrame([(0, 1, 4), (1, 2, 1), (2, 0, 2), (2, 3, 7), (1, 3, 8), (3, 4, 1), (4, 0, 3), (4, 2, 9), (0, 5, 2)], "src bigint, dst bigint, wt bigint")
    ranks = spark.createDataFrame([(0, 4), (1, 0), (2, 3), (3, 1), (4, 2), (5, 5), (6, 6)], "node bigint, rank int")
    built = hierarchy.contract(edges, ranks)
    order = spark.createDataFrame([(n, n) for n in range(7)], "node bigint, place bigint")
    queries = spark.createDataFrame([(a * 7 + b, a, b) for a in range(7) for b in range(7)], "qid bigint, source bigint, target bigint")
    runs = labels.compress_rows(labels.move_sets(hierarchy.first_moves(built, ranks)), order)
    got = {(r["source"], r["target"]): r["cost"] for r in hierarchy.first_move_costs(built, ranks, queries, runs, order).collect()}
    want = {(a, b): 0 if a == b else None for a in range(7) for b in range(7)}
    for _ in range(7):
        for a, b, w in ((r["src"], r["dst"], r["wt"]) for r in edges.collect()):
            for c in range(7):
                if want[b, c] is not None and (want[a, c] is None or w + want[b, c] < want[a, c]):
                    want[a, c] = w + want[b, c]
    assert got == want and want[5, 0] is None and want[6, 6] == 0
