"""Interval searches against the visibility search, and polygon kernels."""

import random
import sys

import numpy as np
import pytest

from pathloom.operators import intervals, kernels, mesh, polygons


def grids(n, size=11, seed=0):
    rng = random.Random(seed)
    for i in range(n):
        h, w = rng.randrange(2, size), rng.randrange(2, size)
        yield np.random.RandomState(seed + i).rand(h, w) > rng.choice((0.1, 0.25, 0.4)), rng


def test_lattice_paths_whatever_the_mesh():
    for free, rng in grids(80):
        h, w = free.shape
        meshes = [intervals.rectangle_mesh(intervals.row_runs(free)), intervals.rectangle_mesh(mesh.best_rectangles(free)), intervals.rectangle_mesh(mesh.grown_rectangles(free))]
        for _ in range(5):
            a, b = ((rng.randrange(w + 1), rng.randrange(h + 1)) for _ in range(2))
            want = kernels.any_angle(free.astype(np.uint8), a, b)[0]
            for area in meshes:
                got, path = intervals.grid_interval_search(area, a, b)
                assert (want is None) == (got is None) and (want is None or abs(want - got) < 1e-6)
                if got is not None:
                    assert abs(sum(intervals._far(p, q) for p, q in zip(path, path[1:])) - got) < 1e-6


def test_merged_polygons_keep_lengths():
    for free, rng in grids(25, 9, 100):
        h, w = free.shape
        unit = [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)] for y in range(h) for x in range(w) if free[y, x]]
        if not unit:
            continue
        whole = intervals.IntervalMesh(unit)
        for keep in (True, False):
            rings = polygons.merged(unit, keep_dead_ends=keep)
            assert len(rings) <= len(unit) and all(polygons.convex(r) for r in rings)
            assert abs(sum(map(polygons.area2, rings)) - 2 * free.sum()) < 1e-9
            joined = intervals.IntervalMesh(rings)
            for _ in range(4):
                (ya, xa), (yb, xb) = (rng.choice(np.argwhere(free).tolist()) for _ in range(2))
                a, b = (xa + 0.5, ya + 0.25), (xb + 0.5, yb + 0.75)
                one, two = intervals.interval_search(whole, a, b)[0], intervals.interval_search(joined, a, b)[0]
                assert (one is None) == (two is None) and (one is None or abs(one - two) < 1e-6)


def test_traced_rings_enclose_the_free_cells():
    for free, _ in grids(60, 10, 300):
        rings = polygons.traced(free)
        assert abs(sum(polygons.area2(r) for r, _ in rings) - 2 * free.sum()) < 1e-9
        assert all((polygons.area2(r) > 0) == (depth % 2 == 0) for r, depth in rings)
    ring = np.ones((5, 5), bool)
    ring[1:4, 1:4] = False
    ring[2, 2] = True
    assert sorted(d for _, d in polygons.traced(ring)) == [0, 1, 2]


SQUARES = [[(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 1), (2, 1), (2, 2), (1, 2)]]


def test_places_of_points():
    area = intervals.IntervalMesh([[(0, 0), (2, 0), (2, 1), (0, 1)], [(2, 0), (3, 0), (3, 1), (2, 1)]])
    assert [area.located(p)[0] for p in ((1, 0.5), (2, 0.5), (0, 0), (5, 5))] == ["inside", "side", "vertex", "outside"]
    touch = intervals.IntervalMesh(SQUARES)
    assert touch.located((1, 1))[0] == "ambiguous" and touch.started((1, 1), shift=True) == [1] and touch.started((1, 1), shift=False) == [0, 1]
    # Nothing passes where only corners touch.
    assert intervals.interval_search(touch, (0.5, 0.5), (1.5, 1.5)) == (None, [])
    assert intervals.interval_search(touch, (1, 1), (1.5, 1.5), shift=True)[0] == pytest.approx(0.5**0.5)
    assert intervals.interval_search(touch, (1, 1), (0.5, 0.5), shift=False)[0] == pytest.approx(0.5**0.5)


def test_collinear_sides():
    """Ends on one line with sides and corners, at 0, 45 and 90 degrees."""
    free = np.array([[1, 1, 1, 1, 1], [1, 0, 1, 0, 1], [1, 1, 1, 1, 1]], bool)
    area = intervals.rectangle_mesh(intervals.row_runs(free))
    for a, b, want in (((0, 1), (5, 1), 5.0), ((1, 0), (1, 3), 3.0), ((0, 0), (3, 3), None), ((2, 1), (2, 2), 1.0), ((0, 2), (5, 2), 5.0)):
        got = intervals.interval_search(area, a, b)[0]
        assert got == pytest.approx(kernels.any_angle(free.astype(np.uint8), a, b)[0]) and (want is None or got == pytest.approx(want))


def test_diagonal_gaps_stop_sight():
    free = np.array([[1, 0], [0, 1]], np.uint8)
    assert kernels.any_angle(free, (0, 0), (2, 2))[0] is None
    assert kernels.any_angle(free[::-1].copy(), (2, 0), (0, 2))[0] is None


def test_an_expanded_part_costs_few_calls(monkeypatch):
    """Parts lie in the heap as plain tuples and sides know their number behind, so that heap and ring cost no calls in Python."""
    free = (np.random.default_rng(21).random((60, 60)) < 0.8).astype(np.uint8)
    area = intervals.rectangle_mesh(intervals.row_runs(free))
    calls, expanded, plain = [], [], intervals.successors

    def seen(*part):
        expanded.append(1)
        return plain(*part)

    monkeypatch.setattr(intervals, "successors", seen)

    def count(frame, event, _):
        if event == "call":
            calls.append(1)

    for k in range(1, 60, 7):
        sys.setprofile(count)
        try:
            intervals.grid_interval_search(area, (1, k), (58, 59 - k))
        finally:
            sys.setprofile(None)
    assert len(expanded) > 1000
    assert len(calls) < 30 * len(expanded), (len(calls), len(expanded))


def test_meshes_of_rectangles_are_flat_arrays():
    import tracemalloc

    free = (np.random.RandomState(3).rand(300, 300) > 0.2).astype(np.uint8)
    for build in (intervals.row_runs, lambda f: mesh.best_rectangles(f > 0)):
        tracemalloc.start()
        area = intervals.rectangle_mesh(build(free))
        kept, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        # Objects took some 4,800 bytes a polygon at the peak.
        assert kept < 200 * len(area.rings) and peak < 1000 * len(area.rings)
        plain = intervals.IntervalMesh([area.rings[i] for i in range(len(area.rings))])
        assert all(plain.behind[i] == area.behind[i] and plain.entry[i] == area.entry[i] and plain.dead[i] == area.dead[i] for i in range(len(area.rings)))
        assert all((area.corners.get(p) == ()) == (wedge == ()) and area.corners.get(p) is not None for p, wedge in plain.corners.items())
