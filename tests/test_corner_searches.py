"""Corner searches over broadcast walks: equal to A*, and in a number of jobs that does not follow the paths' lengths."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from pathloom.operators import hierarchy, jumps, kernels
from pathloom.operators.graph import collapse
from pathloom.plans.lineage import cut

SF = "/root/testdata/sf0.001"


def cells_of(spark, free):
    h, w = free.shape
    return spark.createDataFrame([(x, y, bool(free[y, x])) for y in range(h) for x in range(w)], "x bigint, y bigint, ok boolean")


def jobs_of(spark, name):
    """(jobs, rows) of a query."""
    spark.sparkContext.setJobGroup(name, name)
    rows = entry.queries()[name](spark, SF).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return jobs, rows


@pytest.mark.parametrize("pruned", [False, True])
def test_corner_searches_equal_astar(spark, pruned):
    for seed, share in ((1, 0.15), (2, 0.3), (3, 0.45)):
        rng = random.Random(seed)
        free = (np.random.RandomState(seed).rand(17, 19) > share).astype(np.uint8)
        walks = jumps.walks_of(cells_of(spark, free))
        for _ in range(300):
            a, b = ((rng.randrange(-1, 20), rng.randrange(-1, 18)) for _ in range(2))
            assert jumps.corner_search(walks, a, b, pruned)[0] == kernels.astar(free, a, b)[0]


@pytest.mark.parametrize("name", ["corner_graph_search", "pruned_corner_search"])
def test_corner_searches_take_few_jobs(spark, name):
    jobs, rows = jobs_of(spark, name)
    assert rows and jobs < 60  # 126 and 131 by rounds


def test_contracted_corners_are_searched_as_astar_does(spark):
    rng = random.Random(7)
    free = (np.random.RandomState(7).rand(23, 21) > 0.25).astype(np.uint8)
    graph = jumps.corner_graph(cells_of(spark, free), 21)
    for tile in (6, 64):
        built, ranks = hierarchy.tile_contract(cut(collapse(graph.edges)), 21, 80.0, tile)
        told = {r["node"]: r["rank"] for r in ranks.collect()}
        assert sum(rank == max(told.values()) for rank in told.values()) <= len(told) * 0.2 + 1
        domain = jumps.CornerHierarchy(jumps.walks_of(cells_of(spark, free), graph.table), built, ranks, 21)
        for _ in range(300):
            a, b = ((rng.randrange(21), rng.randrange(23)) for _ in range(2))
            want = kernels.astar(free, a, b)[0]
            assert jumps.corner_hierarchy_search(domain, a, b)[0] == want == jumps.corner_hierarchy_search(domain, a, b, forward=True)[0]
