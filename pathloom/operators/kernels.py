"""Query-parallel search kernels: the table of queries is partitioned, each task searches a broadcast domain.

These are for many queries over one grid, where relaxation would need as many
rounds as the grid is wide.  The grid is broadcast as one byte per cell and
only if it has at most ``MAX_CELLS`` cells; beyond that ``search.relax`` over
``grid.to_graph`` is the way, and ``grid_array`` says so.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.geometry import SCALE, SCALED_DIAGONAL
from pathloom.plans.lineage import cut

#: Largest grid that is broadcast, in cells.
MAX_CELLS = 64_000_000


def grid_array(cells: DataFrame, value: str = "ok") -> np.ndarray:
    """cells(x, y, value) as an array [y, x]; zero where there is no cell."""
    size = cells.agg(F.max("x").alias("w"), F.max("y").alias("h")).first()
    w, h = (size["w"] or 0) + 1, (size["h"] or 0) + 1
    if w * h > MAX_CELLS:
        raise ValueError(f"{w * h} cells are too many to broadcast; use search.relax over grid.to_graph")
    out = np.zeros((h, w), dtype=np.uint8)
    rows = cells.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col(value).cast("short").alias("v")).toArrow()  # ten bytes a cell
    for batch in rows.to_batches():
        x, y, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        out[y, x] = v
    return out


#: Moves by number: the names of ``grid.DIRECTIONS`` in order, whose bits are 1 << number.
MOVES = ((0, -1), (0, 1), (1, 0), (-1, 0), (1, -1), (-1, -1), (1, 1), (-1, 1))
#: The moves of every mask.
MOVES_OF = tuple(tuple(i for i in range(8) if mask >> i & 1) for mask in range(256))


class Field:
    """A grid with a blocked frame as flat bytes, for kernels: a cell (x, y) is number (y + 1) * width + x + 1."""

    def __init__(self, free: np.ndarray) -> None:
        pad = np.zeros((free.shape[0] + 2, free.shape[1] + 2), dtype=bool)
        pad[1:-1, 1:-1] = free > 0
        self.source, self.width = free, pad.shape[1]
        self.delta = tuple(dy * self.width + dx for dx, dy in MOVES)
        at = lambda dx, dy: np.roll(pad, (-dy, -dx), (0, 1))
        legal = np.zeros(pad.shape, dtype=np.uint8)
        for i, (dx, dy) in enumerate(MOVES):
            legal |= (pad & at(dx, dy) & at(dx, 0) & at(0, dy)).astype(np.uint8) << i
        self.free, self.legal = pad.tobytes(), legal.tobytes()
        self._pad, self._turns = pad, None

    def number(self, x: int, y: int) -> int:
        """The cell's number; that of a blocked one for whatever lies outside."""
        h, w = self.source.shape
        return (y + 1) * self.width + x + 1 if 0 <= x < w and 0 <= y < h else 0

    def cell(self, p: int) -> tuple[int, int]:
        y, x = divmod(p, self.width)
        return x - 1, y - 1

    @property
    def turns(self) -> tuple[bytes, ...]:
        """For each straight move, the moves that its arrival in every cell forces: where a cell beside is free and the one behind that blocked."""
        if self._turns is None:
            at = lambda dx, dy: np.roll(self._pad, (-dy, -dx), (0, 1))
            out = []
            for dx, dy in MOVES[:4]:
                mask = np.zeros(self._pad.shape, dtype=np.uint8)
                for sx, sy in ((dy, dx), (-dy, -dx)):
                    forced = self._pad & at(sx, sy) & ~at(sx - dx, sy - dy)
                    mask[forced] |= 1 << MOVES.index((sx, sy)) | 1 << MOVES.index((dx + sx, dy + sy))
                out.append(mask.tobytes())
            self._turns = tuple(out)
        return self._turns


class PointField(Field):
    """The lattice points of a grid in the same form: ``free`` are those that touch a free cell, moves go along its sides or across it.

    ``legal`` has no moves from points where obstacles touch, ``starting`` has them.
    """

    def __init__(self, free: np.ndarray) -> None:
        cell = np.zeros((free.shape[0] + 4, free.shape[1] + 4), dtype=bool)
        cell[2:-2, 2:-2] = free > 0
        nw, ne, sw, se = cell[:-1, :-1], cell[:-1, 1:], cell[1:, :-1], cell[1:, 1:]
        self.source, self.width = free, nw.shape[1]
        self.delta = tuple(dy * self.width + dx for dx, dy in MOVES)
        starting = np.zeros(nw.shape, dtype=np.uint8)
        for i, open_ in enumerate((nw | ne, sw | se, ne | se, nw | sw, ne, nw, se, sw)):
            starting |= open_.astype(np.uint8) << i
        pinched = (nw & se & ~ne & ~sw) | (ne & sw & ~nw & ~se)
        self.free, self.starting, self.legal = (starting > 0).tobytes(), starting.tobytes(), np.where(pinched, 0, starting).astype(np.uint8).tobytes()

    def number(self, x: int, y: int) -> int:
        h, w = self.source.shape
        return (y + 1) * self.width + x + 1 if 0 <= x <= w and 0 <= y <= h else 0


_FIELDS: list[Field] = []


def field(free: np.ndarray, form: type[Field] = Field) -> Field:
    """The field of a grid; that of the last one is kept, as a task searches one grid many times."""
    if not _FIELDS or _FIELDS[0].source is not free or type(_FIELDS[0]) is not form:
        _FIELDS[:] = [form(free)]
    return _FIELDS[0]


def octile(dx: int, dy: int) -> int:
    return min(dx, dy) * SCALED_DIAGONAL + abs(dx - dy) * SCALE


def astar(free: np.ndarray, start: tuple[int, int], goal: tuple[int, int], moves: int = 8, terrain: bool = False) -> tuple[int | None, list]:
    """(cost, path) over a grid; ``terrain`` doubles as cell costs: straight moves cost the mean of both cells, diagonals √2 times that of four."""
    if not terrain:
        return _flat_astar(field(free), start, goal, moves)
    h, w = free.shape
    inside = lambda x, y: 0 <= x < w and 0 <= y < h and free[y, x] > 0
    if not (inside(*start) and inside(*goal)):
        return None, []
    least = int(free[free > 0].min())
    bound = (lambda x, y: octile(abs(x - goal[0]), abs(y - goal[1]))) if moves == 8 else (lambda x, y: (abs(x - goal[0]) + abs(y - goal[1])) * SCALE)
    g, parent, closed = {start: 0}, {start: None}, set()
    heap = [(least * bound(*start), 0, start)]
    while heap:
        _, _, at = heapq.heappop(heap)
        if at in closed:
            continue
        closed.add(at)
        if at == goal:
            path = []
            while at is not None:
                path.append(at)
                at = parent[at]
            return g[goal], path[::-1]
        x, y = at
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                if (dx or dy) and inside(x + dx, y + dy) and (dx == 0 or dy == 0 or (moves == 8 and inside(x + dx, y) and inside(x, y + dy))):
                    cells = [free[y, x], free[y + dy, x + dx]] if dx == 0 or dy == 0 else [free[y, x], free[y + dy, x + dx], free[y + dy, x], free[y, x + dx]]
                    mean = sum(int(c) for c in cells) / len(cells)
                    cost = g[at] + int(mean * (SCALE if dx == 0 or dy == 0 else SCALED_DIAGONAL))
                    to = (x + dx, y + dy)
                    if cost < g.get(to, math.inf):
                        g[to], parent[to] = cost, at
                        heapq.heappush(heap, (cost + least * bound(*to), -cost, to))
    return None, []


def point_astar(free: np.ndarray, start: tuple[int, int], goal: tuple[int, int]) -> tuple[int | None, list]:
    """(cost, path) between lattice points; those where obstacles touch are left only by the start."""
    if start == goal:
        return 0, [start]
    grid = field(free, PointField)
    first, legal = grid.number(*start), grid.legal
    if legal[first] != grid.starting[first]:
        legal = bytearray(legal)
        legal[first] = grid.starting[first]
    return _flat_astar(grid, start, goal, 8, legal)


def _flat_astar(grid: Field, start: tuple[int, int], goal: tuple[int, int], moves: int, legal: bytes | bytearray | None = None) -> tuple[int | None, list]:
    width, legal, (gx, gy) = grid.width, grid.legal if legal is None else legal, (goal[0] + 1, goal[1] + 1)
    first, last = grid.number(*start), grid.number(*goal)
    if not (grid.free[first] and grid.free[last]):
        return None, []
    ways = [tuple((grid.delta[i], SCALE if i < 4 else SCALED_DIAGONAL) for i in MOVES_OF[m if moves == 8 else m & 15]) for m in range(256)]
    far, near = (SCALE, SCALED_DIAGONAL - SCALE) if moves == 8 else (SCALE, SCALE)  # of the longer and of the shorter way along an axis
    g, parent, closed = {first: 0}, {first: -1}, set()
    heap = [(0, 0, first)]
    while heap:
        _, _, at = heapq.heappop(heap)
        if at in closed:
            continue
        closed.add(at)
        if at == last:
            path, cost = [], g[at]
            while at >= 0:
                path.append(grid.cell(at))
                at = parent[at]
            return cost, path[::-1]
        done = g[at]
        for step, price in ways[legal[at]]:
            to, cost = at + step, done + price
            if cost < g.get(to, math.inf):
                g[to], parent[to] = cost, at
                y, x = divmod(to, width)
                x, y = abs(x - gx), abs(y - gy)
                heapq.heappush(heap, (cost + (far * x + near * y if x > y else far * y + near * x), -cost, to))
    return None, []


def jump_search(free: np.ndarray, start: tuple[int, int], goal: tuple[int, int]) -> tuple[int | None, list]:
    """(cost, path of turning points) by jump points, without cutting corners.

    Without corner cutting a turn is forced where a cell beside the line is
    free and the one behind it is blocked.
    """
    h, w = free.shape
    inside = lambda x, y: 0 <= x < w and 0 <= y < h and free[y, x] > 0
    if not (inside(*start) and inside(*goal)):
        return None, []

    def straight(x: int, y: int, dx: int, dy: int) -> tuple[int, int] | None:
        while inside(x + dx, y + dy):
            x, y = x + dx, y + dy
            if (x, y) == goal:
                return x, y
            for sx, sy in ((dy, dx), (-dy, -dx)):
                if inside(x + sx, y + sy) and not inside(x + sx - dx, y + sy - dy):
                    return x, y
        return None

    def diagonal(x: int, y: int, dx: int, dy: int) -> tuple[int, int] | None:
        while inside(x + dx, y + dy) and inside(x + dx, y) and inside(x, y + dy):
            x, y = x + dx, y + dy
            if (x, y) == goal or straight(x, y, dx, 0) or straight(x, y, 0, dy):
                return x, y
        return None

    bound = lambda p: octile(abs(p[0] - goal[0]), abs(p[1] - goal[1]))
    g, parent, closed = {start: 0}, {start: None}, set()
    heap = [(bound(start), 0, start)]
    while heap:
        _, _, at = heapq.heappop(heap)
        if at in closed:
            continue
        closed.add(at)
        if at == goal:
            path = []
            while at is not None:
                path.append(at)
                at = parent[at]
            return g[goal], path[::-1]
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                if dx or dy:
                    to = diagonal(*at, dx, dy) if dx and dy else straight(*at, dx, dy)
                    if to and (cost := g[at] + octile(abs(to[0] - at[0]), abs(to[1] - at[1]))) < g.get(to, math.inf):
                        g[to], parent[to] = cost, at
                        heapq.heappush(heap, (cost + bound(to), -cost, to))
    return None, []


def refine(path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Turning points filled up to unit steps."""
    out = path[:1]
    for (ax, ay), (bx, by) in zip(path, path[1:]):
        sx, sy = (bx > ax) - (bx < ax), (by > ay) - (by < ay)
        out += [(ax + sx * i, ay + sy * i) for i in range(1, max(abs(bx - ax), abs(by - ay)) + 1)]
    return out


def sees(free: np.ndarray, a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether the segment between two lattice points crosses no blocked cell and squeezes through no diagonal gap."""
    h, w = free.shape
    open_ = lambda x, y: 0 <= x < w and 0 <= y < h and free[y, x] > 0
    (x1, y1), (x2, y2) = a, b
    dx, dy = x2 - x1, y2 - y1
    if dx == 0 or dy == 0:
        if dx == 0:
            sides = [(open_(x1 - 1, y), open_(x1, y)) for y in range(min(y1, y2), max(y1, y2))]
        else:
            sides = [(open_(x, y1 - 1), open_(x, y1)) for x in range(min(x1, x2), max(x1, x2))]
        # Changing sides on the way would squeeze through a diagonal gap.
        return all(a or b for a, b in sides) and all((a and c) or (b and d) for (a, b), (c, d) in zip(sides, sides[1:]))
    sx, sy = (1 if dx > 0 else -1), (1 if dy > 0 else -1)
    nx, ny = abs(dx), abs(dy)
    ix = iy = 0
    x, y = x1, y1
    while True:  # the cell entered next, in units of the two axes
        if not open_(x if sx > 0 else x - 1, y if sy > 0 else y - 1):
            return False
        ahead = (ix + 1) * ny - (iy + 1) * nx
        if ahead <= 0:
            ix, x = ix + 1, x + sx
        if ahead >= 0:
            iy, y = iy + 1, y + sy
        if ix >= nx or iy >= ny:
            return True
        beside = ((x - 1, y), (x, y - 1)) if sx == sy else ((x - 1, y - 1), (x, y))
        if ahead == 0 and not (open_(*beside[0]) or open_(*beside[1])):
            return False


def any_angle(free: np.ndarray, start: tuple[int, int], goal: tuple[int, int]) -> tuple[float | None, list]:
    """(length, turning points) of the shortest path between lattice points over free cells; it turns at corners only."""
    h, w = free.shape
    pad = np.zeros((h + 2, w + 2), dtype=bool)
    pad[1:-1, 1:-1] = free > 0
    blocked = 4 - (pad[:-1, :-1].astype(int) + pad[:-1, 1:] + pad[1:, :-1] + pad[1:, 1:])
    turn = [tuple(map(int, p[::-1])) for p in np.argwhere(blocked == 1)]
    for p in (start, goal):
        if not (0 <= p[0] <= w and 0 <= p[1] <= h) or blocked[p[1], p[0]] == 4:
            return None, []
    dist = lambda p, q: math.hypot(p[0] - q[0], p[1] - q[1])
    g, parent, closed = {start: 0.0}, {start: None}, set()
    heap = [(dist(start, goal), start)]
    while heap:
        _, at = heapq.heappop(heap)
        if at in closed:
            continue
        closed.add(at)
        if at == goal:
            path = []
            while at is not None:
                path.append(at)
                at = parent[at]
            return g[goal], path[::-1]
        for to in (goal, *turn):
            cost = g[at] + dist(at, to)
            if to not in closed and cost < g.get(to, math.inf) - 1e-12 and sees(free, at, to):
                g[to], parent[to] = cost, at
                heapq.heappush(heap, (cost + dist(to, goal), to))
    return None, []


#: Queries of one task, about.
TASK_QUERIES = 4


def run_queries(queries: DataFrame, domain: np.ndarray, kernel: Callable, paths: bool = True) -> DataFrame:
    """(qid, cost, path) of queries (qid, sx, sy, tx, ty); null cost where there is no path.

    Queries with the same ends are searched once; the different ones spread
    over tasks of a few each, however few files the queries come from.
    Without ``paths`` there is no such column.
    """
    spark = queries.sparkSession
    shared, ends = spark.sparkContext.broadcast(domain), ["sx", "sy", "tx", "ty"]
    each = cut(queries.select(*ends).distinct())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), each.count() // TASK_QUERIES)
    columns = [*ends, "cost", *(["path"] if paths else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for q in batch.itertuples(index=False):
                cost, path = kernel(shared.value, (int(q.sx), int(q.sy)), (int(q.tx), int(q.ty)))
                rows.append((q.sx, q.sy, q.tx, q.ty, None if cost is None else float(cost), *([[f"{x},{y}" for x, y in path]] if paths else [])))
            yield pd.DataFrame(rows, columns=columns).astype({**dict.fromkeys(ends, "int64"), "cost": "float64"})

    kinds = ", ".join([*(f"{c} bigint" for c in ends), "cost double", *(["path array<string>"] if paths else [])])
    found = each.repartition(tasks, *ends).mapInPandas(run, kinds).withColumn("cost", F.when(F.isnan("cost"), None).otherwise(F.col("cost")))
    return queries.select("qid", *ends).join(cut(found), ends).select("qid", *columns[4:])


#: Largest mesh that is broadcast, in polygons.
MAX_POLYGONS = 2_000_000


def corner_wedges(rings: list[list[tuple[float, float]]]) -> dict[tuple[float, float], tuple]:
    """The vertices at which paths may turn, each with the two directions (ax, ay, bx, by) between which its obstacle lies; none for an ambiguous one."""
    fans: dict[tuple[float, float], list[tuple[tuple, tuple]]] = {}
    for ring in rings:
        a, p = ring[-2], ring[-1]
        for b in ring:
            fans.setdefault(p, []).append((a, b))
            a, p = p, b
    out = {}
    for p, fan in fans.items():
        into, outof = [a for a, _ in fan], [b for _, b in fan]
        ends = [b for b in outof if b not in into]  # sides that no polygon of the fan continues
        if len(ends) > 1:
            out[p] = ()
        elif ends and _reflex(p, fan):
            a, b = next(a for a in into if a not in outof), ends[0]
            out[p] = (a[0] - p[0], a[1] - p[1], b[0] - p[0], b[1] - p[1])
    return out


def _reflex(p: tuple, fan: list) -> bool:
    """Whether the free angle at p exceeds half a turn, so that paths may bend there."""
    total = 0.0
    for a, b in fan:
        one, two = math.atan2(b[1] - p[1], b[0] - p[0]), math.atan2(a[1] - p[1], a[0] - p[0])
        total += (two - one) % (2 * math.pi)
    return total > math.pi + 1e-9


class MeshDomain:
    """Convex polygons of a mesh with the half planes of their sides, and its turning points.

    A vertex where an obstacle meets exactly one gap of the fan around it is a
    turning point; one with several gaps is ambiguous: obstacles touch there
    and nothing passes between them.
    """

    def __init__(self, rings: list[list[tuple[float, float]]], eps: float = 1e-8) -> None:
        if len(rings) > MAX_POLYGONS:
            raise ValueError(f"{len(rings)} polygons are too many to broadcast")
        self.eps = eps
        self.rings = [np.array(r, dtype=float) for r in rings]
        self.sides = [np.roll(r, -1, axis=0) - r for r in self.rings]
        wedges = corner_wedges(rings)
        self.turns, self.ambiguous = [p for p, wedge in wedges.items() if wedge], {p for p, wedge in wedges.items() if not wedge}

    def spans(self, a: tuple, b: tuple) -> list[tuple[float, float, int]]:
        """The part of the segment inside every polygon that it meets, as (from, to, polygon)."""
        out = []
        ax, ay, dx, dy = a[0], a[1], b[0] - a[0], b[1] - a[1]
        for i, (ring, side) in enumerate(zip(self.rings, self.sides, strict=True)):
            at = side[:, 0] * (ay - ring[:, 1]) - side[:, 1] * (ax - ring[:, 0])
            move = side[:, 0] * dy - side[:, 1] * dx
            flat = np.abs(move) < 1e-12
            if (at[flat] < -self.eps).any():
                continue
            t = np.full(len(at), 0.0)
            t[~flat] = -at[~flat] / move[~flat]
            low = max(0.0, t[~flat & (move > 0)].max(initial=0.0))
            high = min(1.0, t[~flat & (move < 0)].min(initial=1.0))
            if low <= high + 1e-9:
                out.append((low, high, i))
        return sorted(out)

    def sees(self, a: tuple, b: tuple) -> bool:
        """Whether the segment stays inside the mesh and passes no ambiguous vertex."""
        reach = 0.0
        for low, high, _ in (spans := self.spans(a, b)):
            if low > reach + 1e-9:
                return False
            reach = max(reach, high)
        if not spans or reach < 1 - 1e-9:
            return False
        length2 = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        for p in self.ambiguous:
            t = ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / length2 if length2 else 0.0
            if 1e-9 < t < 1 - 1e-9 and math.hypot(a[0] + t * (b[0] - a[0]) - p[0], a[1] + t * (b[1] - a[1]) - p[1]) < 1e-9:
                # Only a segment along a side that two polygons or one share may touch it.
                if not any(low < t - 1e-9 and high > t + 1e-9 for low, high, _ in spans):
                    return False
        return True

    def holds(self, p: tuple) -> bool:
        return bool(self.spans(p, p))


def mesh_any_angle(mesh: MeshDomain, start: tuple, goal: tuple) -> tuple[float | None, list]:
    """(length, turning points) of the shortest path inside a mesh; null when an end lies outside or there is none."""
    if not (mesh.holds(start) and mesh.holds(goal)):
        return None, []
    dist = lambda p, q: math.hypot(p[0] - q[0], p[1] - q[1])
    g, parent, closed = {start: 0.0}, {start: None}, set()
    heap = [(dist(start, goal), start)]
    while heap:
        _, at = heapq.heappop(heap)
        if at in closed:
            continue
        closed.add(at)
        if at == goal:
            path = []
            while at is not None:
                path.append(at)
                at = parent[at]
            return g[goal], path[::-1]
        for to in (goal, *mesh.turns):
            cost = g[at] + dist(at, to)
            if to not in closed and cost < g.get(to, math.inf) - 1e-12 and mesh.sees(at, to):
                g[to], parent[to] = cost, at
                heapq.heappush(heap, (cost + dist(to, goal), to))
    return None, []
