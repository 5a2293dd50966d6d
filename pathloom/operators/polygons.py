"""Sequential polygon kernels, one map a task: convex merging and boundary tracing."""

from __future__ import annotations

import heapq

import numpy as np

Point = tuple[float, float]


def area2(ring: list[Point]) -> float:
    """Twice the signed area."""
    return sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def _turn(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex(ring: list[Point], eps: float = 1e-9) -> bool:
    n = len(ring)
    return all(_turn(ring[i - 1], ring[i], ring[(i + 1) % n]) >= -eps for i in range(n))


def joined(one: list[Point], two: list[Point]) -> list[Point] | None:
    """The ring around two counter-clockwise rings that share one run of sides; None if they share none, or several."""
    ends = dict(zip(one, one[1:] + one[:1], strict=True))
    shared = {a for a, b in zip(two, two[1:] + two[:1], strict=True) if ends.get(b) == a}  # starts, in two, of shared sides
    if not shared:
        return None
    n = len(two)
    at = [i for i in range(n) if two[i] in shared and two[i - 1] not in shared]
    if len(at) != 1:
        return None
    last = at[0]
    while two[(last + 1) % n] in shared:
        last += 1
    into, outof = two[at[0]], two[(last + 1) % n]  # one is left at ``outof`` of two: its run goes from outof to into
    k = one.index(into)
    rest_one = one[k:] + one[:k]
    rest_one = rest_one[: rest_one.index(outof) + 1]
    j = two.index(outof)
    rest_two = two[j:] + two[:j]
    rest_two = rest_two[: rest_two.index(into) + 1]
    return rest_one + rest_two[1:-1]


def merged(rings: list[list[Point]], keep_dead_ends: bool = True) -> list[list[Point]]:
    """Neighbours joined while the result is convex, the largest result first.

    With ``keep_dead_ends`` a polygon with one neighbour only stays as it is: a
    search skips it unless its goal is inside.
    """
    parts: dict[int, list[Point]] = dict(enumerate(rings))
    owner = {(a, b): i for i, ring in parts.items() for a, b in zip(ring, ring[1:] + ring[:1], strict=True)}

    def beside(i: int) -> set[int]:
        ring = parts[i]
        return {owner[b, a] for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if (b, a) in owner} - {i}

    around = {i: beside(i) for i in parts}
    still = {i for i, held in around.items() if keep_dead_ends and len(held) == 1}
    heap: list = []

    def offer(i: int, j: int) -> None:
        if i in still or j in still:
            return
        ring = joined(parts[i], parts[j])
        if ring is not None and convex(ring):
            heapq.heappush(heap, (-area2(ring), min(i, j), max(i, j), ring))

    for i, held in around.items():
        for j in held:
            if i < j:
                offer(i, j)
    new = len(rings)
    while heap:
        _, i, j, ring = heapq.heappop(heap)
        if i not in parts or j not in parts:
            continue
        del parts[i], parts[j]
        parts[new] = ring
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            owner[a, b] = new
        around[new] = (around.pop(i) | around.pop(j)) - {i, j}
        for k in around[new]:
            around[k] = (around[k] - {i, j}) | {new}
            offer(new, k)
        new += 1
    return [parts[i] for i in sorted(parts)]


def traced(free: np.ndarray) -> list[tuple[list[Point], int]]:
    """(ring, depth) of the borders between free and blocked cells, free ones on the left, corners only.

    Rings of depth 0 enclose free areas, those of depth 1 the blocked areas in
    them, and so on.  Where obstacles touch, the ring keeps to its own cell.
    """
    h, w = free.shape
    pad = np.zeros((h + 2, w + 2), dtype=bool)
    pad[1:-1, 1:-1] = free > 0
    open_ = lambda x, y: bool(pad[y + 1, x + 1])
    ahead: dict[Point, list[Point]] = {}
    for y in range(h):
        for x in range(w):
            if open_(x, y):
                for a, b, out in (((x, y), (x + 1, y), open_(x, y - 1)), ((x + 1, y), (x + 1, y + 1), open_(x + 1, y)), ((x + 1, y + 1), (x, y + 1), open_(x, y + 1)), ((x, y + 1), (x, y), open_(x - 1, y))):
                    if not out:
                        ahead.setdefault(a, []).append(b)
    rings = []
    while ahead:
        start = min(ahead)
        ring, at = [start], ahead[start][0]
        ahead[start].remove(at)
        if not ahead[start]:
            del ahead[start]
        before = start
        while at != start:
            ring.append(at)
            ways = ahead[at]
            # Two ways: the one that turns towards the cell that the ring borders.
            to = max(ways, key=lambda p: _turn(before, at, p))
            ways.remove(to)
            if not ways:
                del ahead[at]
            before, at = at, to
        n = len(ring)
        rings.append([ring[i] for i in range(n) if _turn(ring[i - 1], ring[i], ring[(i + 1) % n]) != 0])

    def encloses(ring: list[Point], p: Point) -> bool:
        inside = False
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
                inside = not inside
        return inside

    out = []
    for i, ring in enumerate(rings):
        # A point just inside the cell to the left of the first side.
        (ax, ay), (bx, by) = ring[0], ring[1]
        n = max(abs(bx - ax), abs(by - ay))
        ux, uy = (bx - ax) / n, (by - ay) / n
        p = (ax + ux / 2 + uy / 4, ay + uy / 2 - ux / 4)  # on the right: outside of a ring around free cells
        out.append((ring, sum(encloses(other, p) for j, other in enumerate(rings) if j != i)))
    return out
