"""Jump point searches: direction rules, successors scanned on the way or read from a table, and the graph of corners.

Without corner cutting a turn is forced after a straight step where a cell
beside is free and the one behind it is blocked; it leads to that side and to
the diagonal ahead on it.  Diagonal steps force nothing.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import geometry as geo
from pathloom.operators import grid, hierarchy, search
from pathloom.operators.graph import collapse
from pathloom.operators.kernels import MOVES, MOVES_OF, Field, field, grid_array
from pathloom.plans.lineage import cut

_ALL = 255
_BACK = {"N": "S", "S": "N", "E": "W", "W": "E"}
_SIDES = {"N": "EW", "S": "EW", "E": "NS", "W": "NS"}


def _pair(a: str, b: str) -> str:
    """The diagonal of two straight directions."""
    return a + b if a in "NS" else b + a


def successor_mask(free: Column, arrived: Column) -> Column:
    """Bits of the directions to go on in from a cell: natural and forced ones; all where ``arrived`` is null (a start).

    ``free`` is the mask of the free cells around; directions into blocked
    cells are taken out.
    """
    out = F.lit(_ALL)
    for name in grid.DIRECTIONS:
        bit = lambda n: grid.DIRECTIONS[n][2]
        if len(name) == 2:
            mask = F.lit(bit(name) | bit(name[0]) | bit(name[1]))
        else:
            mask = F.lit(bit(name))
            for side in _SIDES[name]:
                forced = grid.has(free, side) & grid.lacks(free, _pair(side, _BACK[name]))
                mask = mask.bitwiseOR(F.when(forced, bit(side) | bit(_pair(side, name))).otherwise(0))
        out = F.when(arrived == name, mask).otherwise(out)
    legal = F.lit(0)
    for name, (_, _, own) in grid.DIRECTIONS.items():
        legal = legal.bitwiseOR(F.when(grid.has(free, name, *(name if len(name) == 2 else "")), own).otherwise(0))
    return out.bitwiseAND(legal)


Cell = tuple[int, int]


#: Numbers of moves by step, and the two straight moves of each diagonal one.
_NUMBER = {step: i for i, step in enumerate(MOVES)}
_PARTS = {i: (_NUMBER[MOVES[i][0], 0], _NUMBER[0, MOVES[i][1]]) for i in range(4, 8)}
#: The arrival of a start.
_NONE = 8


def _best_first(area: Field, start: Cell, goal: Cell, successors: Callable) -> tuple[int | None, list]:
    """(cost, path) over states (cell number, move of arrival); ``successors`` yields (cell number, move, cost)."""
    width, (gx, gy) = area.width, (goal[0] + 1, goal[1] + 1)
    first, last = area.number(*start), area.number(*goal)
    if not (area.free[first] and area.free[last]):
        return None, []
    state = first * 9 + _NONE
    g, parent, closed = {state: 0}, {state: -1}, set()
    heap = [(0, 0, state)]
    while heap:
        _, _, state = heapq.heappop(heap)
        if state in closed:
            continue
        closed.add(state)
        at, arrived = divmod(state, 9)
        done = g[state]
        if at == last:
            path = []
            while state >= 0:
                path.append(area.cell(state // 9))
                state = parent[state]
            return done, path[::-1]
        for to, move, price in successors(at, arrived):
            new, cost = to * 9 + move, done + price
            if cost < g.get(new, math.inf):
                g[new], parent[new] = cost, state
                y, x = divmod(to, width)
                x, y = abs(x - gx), abs(y - gy)
                heapq.heappush(heap, (cost + (geo.SCALE * max(x, y) + (geo.SCALED_DIAGONAL - geo.SCALE) * min(x, y)), -cost, new))
    return None, []


def _onward(area: Field) -> Callable[[int, int], tuple[int, ...]]:
    """The moves to go on with from a cell after a move: natural and forced ones."""
    turns = area.turns

    def moves(at: int, arrived: int) -> tuple[int, ...]:
        if arrived < 4:
            mask = turns[arrived][at]
            return (arrived, *MOVES_OF[mask]) if mask else (arrived,)
        return MOVES_OF[_ALL] if arrived == _NONE else (arrived, *_PARTS[arrived])

    return moves


def online(free: np.ndarray, start: Cell, goal: Cell, through: bool = False) -> tuple[int | None, list]:
    """Jump points found by scanning.  ``through`` leaves out the diagonal stops: what their straight jumps find follows at once."""
    area = field(free)
    open_, legal, turns, delta, last = area.free, area.legal, area.turns, area.delta, area.number(*goal)
    onward = _onward(area)

    def straight(at: int, move: int) -> tuple[int, int]:
        """(cell, cost) of the first stop; 0 for none."""
        step, turn, to, n = delta[move], turns[move], at + delta[move], 1
        while open_[to]:
            if turn[to] or to == last:
                return to, n * geo.SCALE
            to += step
            n += 1
        return 0, 0

    def successors(at: int, arrived: int):
        for move in onward(at, arrived):
            if move < 4:
                to, cost = straight(at, move)
                if to:
                    yield to, move, cost
                continue
            bit, step, (h, v), to, cost = 1 << move, delta[move], _PARTS[move], at, 0
            while legal[to] & bit:
                to += step
                cost += geo.SCALED_DIAGONAL
                if to == last:
                    yield to, move, cost
                    break
                one, two = straight(to, h), straight(to, v)
                if not (one[0] or two[0]):
                    continue
                if not through:
                    yield to, move, cost
                    break
                if one[0]:
                    yield one[0], h, cost + one[1]
                if two[0]:
                    yield two[0], v, cost + two[1]

    return _best_first(area, start, goal, successors)


@dataclass
class Jumps:
    """A grid with its jump distances: code[move, cell number of ``Field``] is the steps of a walk, or -1 - steps where it ends dead."""

    free: np.ndarray
    code: np.ndarray


def jumps_of(cells: DataFrame, table: DataFrame) -> Jumps:
    """Arrays of a grid and of its table (x, y, dir, steps, dead_end) of all eight directions, for broadcast; bounded as ``grid_array`` is.

    One direction at a time is collected, as eight bytes a cell.
    """
    free = grid_array(cells)
    h, w = free.shape
    out = np.full((8, (h + 2) * (w + 2)), -1, dtype=np.int16 if max(h, w) < 2**15 else np.int32)
    number = ((F.col("y") + 1) * (w + 2) + F.col("x") + 1).cast("int")
    coded = cut(table.select("dir", number.alias("p"), F.when(F.col("dead_end"), -1 - F.col("steps")).otherwise(F.col("steps")).cast("int").alias("code")))
    for i, name in enumerate(grid.DIRECTIONS):
        for batch in coded.where(F.col("dir") == name).select("p", "code").toArrow().to_batches():
            out[i, batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return Jumps(free, out)


def offline(jumps: Jumps, start: Cell, goal: Cell, through: bool = False) -> tuple[int | None, list]:
    """Jump points read from the table; the goal is met where it lies before a stop."""
    area = field(jumps.free)
    code, delta, width, (gx, gy) = [memoryview(c) for c in jumps.code], area.delta, area.width, (goal[0] + 1, goal[1] + 1)
    last, onward = area.number(*goal), _onward(area)

    def straight(at: int, move: int) -> tuple[int, int]:
        """(cell, cost) of the goal or else the stop; 0 for none."""
        n = code[move][at]
        dead = n < 0
        if dead:
            n = -1 - n
        y, x = divmod(at, width)
        if x == gx or y == gy:
            dx, dy = MOVES[move]
            ahead = (gx - x) * dx + (gy - y) * dy
            if 0 < ahead <= n and (gx - x) * dy == (gy - y) * dx:
                return last, ahead * geo.SCALE
        return (0, 0) if dead else (at + delta[move] * n, n * geo.SCALE)

    def successors(at: int, arrived: int):
        for move in onward(at, arrived):
            if move < 4:
                to, cost = straight(at, move)
                if to:
                    yield to, move, cost
                continue
            (dx, dy), (h, v), to, done = MOVES[move], _PARTS[move], at, 0
            while True:
                n = code[move][to]
                dead = n < 0
                if dead:
                    n = -1 - n
                # The goal from the cell of the walk that is level with it.
                y, x = divmod(to, width)
                k = min((gx - x) * dx, (gy - y) * dy)
                if 0 < k <= n:
                    level = to + delta[move] * k
                    if level == last or straight(level, h)[0] == last or straight(level, v)[0] == last:
                        yield level, move, done + k * geo.SCALED_DIAGONAL
                if dead:
                    break
                to += delta[move] * n
                done += n * geo.SCALED_DIAGONAL
                if not through:
                    yield to, move, done
                    break
                for part in (h, v):
                    end, cost = straight(to, part)
                    if end:
                        yield end, part, done + cost

    return _best_first(area, start, goal, successors)


def walks(cells: DataFrame) -> DataFrame:
    """(x, y, dir, steps, corner): legal steps from every free cell to the first corner in each of the eight directions, or as far as they go."""
    free = F.col("free")
    corner = F.lit(False)
    for name in ("NE", "NW", "SE", "SW"):
        corner = corner | (grid.lacks(free, name) & grid.has(free, *name))
    around = grid.neighbourhood(cells.select("x", "y", "ok")).withColumn("corner", F.col("ok") & corner)
    out = None
    for name, (dx, dy, _) in grid.DIRECTIONS.items():
        if len(name) == 2:
            ov, oh = _BACK[name[0]], _BACK[name[1]]
            entered, line, along = F.col("ok") & grid.has(free, ov, oh, ov + oh), F.col("x") * dy - F.col("y") * dx, F.col("x") * dx
        else:
            entered, line, along = F.col("ok"), F.col("y") if dx else F.col("x"), F.col("x") * dx + F.col("y") * dy
        halt = F.when(~entered, "wall").when(F.col("corner"), "corner")
        rows = around.select("x", "y", "ok", line.alias("line"), along.alias("along"), halt.alias("halt"))
        ahead = Window.partitionBy("line").orderBy("along").rowsBetween(1, Window.unboundedFollowing)
        hit = F.first(F.when(F.col("halt").isNotNull(), F.struct(F.col("along").alias("at"), F.col("halt").alias("kind"))), ignorenulls=True).over(ahead)
        edge = F.max("along").over(Window.partitionBy("line")) + 1
        found = rows.select("x", "y", "ok", "along", edge.alias("edge"), hit.alias("hit")).where("ok")
        stop = F.coalesce(F.col("hit.kind") == "corner", F.lit(False))
        steps = F.coalesce("hit.at", "edge") - F.col("along") - F.when(stop, 0).otherwise(1)
        part = found.select("x", "y", F.lit(name).alias("dir"), steps.cast("bigint").alias("steps"), stop.alias("corner"))
        out = part if out is None else out.unionByName(part)
    return out


def walks_of(cells: DataFrame, table: DataFrame | None = None) -> Jumps:
    """A grid with its ``walks``, for broadcast: the steps to the first corner, or -1 - steps where a walk meets none."""
    table = walks(cells) if table is None else table
    return jumps_of(cells, table.withColumn("dead_end", ~F.col("corner")))


def hops_from(walks: Jumps) -> Callable:
    """A function of (cell number, moves) for the hops (cell number, last move, cost) of ``corner_hops`` from any cell, read off the walks."""
    code, delta = [memoryview(c) for c in walks.code], field(walks.free).delta
    live = [(code[h], delta[h], h, code[v], delta[v], v) for h, v in (_PARTS[i] for i in range(4, 8))]

    def hops(at: int, moves: tuple[int, ...]):
        for move in moves:
            n, step = code[move][at], delta[move]
            if move < 4:
                if n > 0:
                    yield at + step * n, move, n * geo.SCALE
                continue
            inner = n - 1 if n > 0 else -1 - n
            if n > 0:
                yield at + step * n, move, n * geo.SCALED_DIAGONAL
            one, along, h, two, across, v = live[move - 4]
            to, done = at, 0
            for _ in range(inner):
                to += step
                done += geo.SCALED_DIAGONAL
                m = one[to]
                if m > 0:
                    yield to + along * m, h, done + m * geo.SCALE
                m = two[to]
                if m > 0:
                    yield to + across * m, v, done + m * geo.SCALE

    return hops


def walk_to(walks: Jumps, goal: Cell) -> Callable:
    """A function of a cell number for the (first move, cost) of a diagonal and then straight walk to the goal; (_NONE, -1) where it is blocked."""
    area = field(walks.free)
    code, delta, width, (gx, gy) = [memoryview(c) for c in walks.code], area.delta, area.width, (goal[0] + 1, goal[1] + 1)

    def walk(at: int) -> tuple[int, int]:
        y, x = divmod(at, width)
        dx, dy = gx - x, gy - y
        sx, sy = (dx > 0) - (dx < 0), (dy > 0) - (dy < 0)
        k, long = (dx * sx, dy * sy) if dx * sx < dy * sy else (dy * sy, dx * sx)
        first, cost = _NONE, 0
        for move, left, unit in ((_NUMBER[sx, sy] if k else _NONE, k, geo.SCALED_DIAGONAL), (_NUMBER[(sx, 0) if dx * sx > dy * sy else (0, sy)] if long > k else _NONE, long - k, geo.SCALE)):
            if not left:
                continue
            first = move if first == _NONE else first
            n = code[move][at]
            if (n if n >= 0 else -1 - n) < left:
                return _NONE, -1
            at += delta[move] * left
            cost += left * unit
        return first, cost

    return walk


def corner_search(walks: Jumps, start: Cell, goal: Cell, pruned: bool = False) -> tuple[int | None, list]:
    """Best-first search over the graph of corners, whose edges are read off the walks; the start's are, too, and every corner looks for the goal.

    ``pruned`` goes on from a corner only in the directions that its arrival calls for.
    """
    area = field(walks.free)
    last, hops, walk, onward = area.number(*goal), hops_from(walks), walk_to(walks, goal), _onward(area) if pruned else lambda at, arrived: MOVES_OF[_ALL]

    def successors(at: int, arrived: int):
        moves = onward(at, arrived)
        first, cost = walk(at)
        if cost >= 0 and first in moves:
            yield last, _NONE, cost
        for to, move, cost in hops(at, moves):
            yield to, move if pruned else _NONE, cost

    return _best_first(area, start, goal, successors)


def _moved(c: str, name: Column, n: Column) -> Column:
    """A coordinate after n steps in a direction."""
    plus, minus = ("E", "W") if c == "x" else ("S", "N")
    return F.when(name.contains(plus), n).when(name.contains(minus), -n).otherwise(0)


def _opposite(d: Column) -> Column:
    return F.translate(d, "NSEW", "SNWE")


def corner_hops(table: DataFrame, sources: DataFrame) -> DataFrame:
    """(x, y, x2, y2, wt, first, last): from each source cell (x, y) the first corners of walks: straight, diagonal, and straight after some diagonal steps."""
    wide = sources.join(table, ["x", "y"])
    n, name, k = F.col("steps"), F.col("dir"), F.col("k")
    unit = F.when(F.length("dir") == 2, geo.SCALED_DIAGONAL).otherwise(geo.SCALE)
    plain = wide.where("corner").select("x", "y", (F.col("x") + _moved("x", name, n)).alias("x2"), (F.col("y") + _moved("y", name, n)).alias("y2"), (n * unit).alias("wt"), name.alias("first"), name.alias("last"))
    inner = wide.where("length(dir) = 2").withColumn("most", n - F.col("corner").cast("int")).where("most > 0")
    inner = inner.select("x", "y", F.col("dir").alias("diag"), F.explode(F.sequence(F.lit(1).cast("bigint"), "most")).alias("k"))
    diag = F.col("diag")
    inner = inner.select("x", "y", "diag", "k", (F.col("x") + _moved("x", diag, k)).alias("cx"), (F.col("y") + _moved("y", diag, k)).alias("cy"))
    live = table.where("corner and length(dir) = 1").select(F.col("x").alias("cx"), F.col("y").alias("cy"), "dir", "steps")
    turned = inner.join(live, ["cx", "cy"]).where("contains(diag, dir)").select(
        "x", "y", (F.col("cx") + _moved("x", name, n)).alias("x2"), (F.col("cy") + _moved("y", name, n)).alias("y2"), (k * geo.SCALED_DIAGONAL + n * geo.SCALE).alias("wt"), diag.alias("first"), name.alias("last")
    )
    return plain.unionByName(turned)


def target_hops(table: DataFrame, targets: DataFrame) -> DataFrame:
    """(x, y, x2, y2, wt, first, last): into each target cell (x2, y2) from the corners (x, y) whose walks, diagonal and then straight, meet no other corner before."""
    at = targets.select(F.col("x").alias("x2"), F.col("y").alias("y2"))
    back = at.join(table.select(F.col("x").alias("x2"), F.col("y").alias("y2"), _opposite(F.col("dir")).alias("line"), "steps", "corner"), ["x2", "y2"])
    straight = back.where("length(line) = 1")
    n, line, k = F.col("steps"), F.col("line"), F.col("k")
    away = lambda c, name, m: F.col(f"{c}2") - _moved(c, name, m)
    unit = F.when(F.length("line") == 2, geo.SCALED_DIAGONAL).otherwise(geo.SCALE)
    plain = back.where("corner").select(away("x", line, n).alias("x"), away("y", line, n).alias("y"), "x2", "y2", (n * unit).alias("wt"), line.alias("first"), line.alias("last"))
    inner = straight.withColumn("most", n - F.col("corner").cast("int")).where("most > 0").select("x2", "y2", "line", F.explode(F.sequence(F.lit(1).cast("bigint"), "most")).alias("k"))
    inner = inner.select("x2", "y2", "line", "k", away("x", line, k).alias("cx"), away("y", line, k).alias("cy"))
    live = table.where("corner and length(dir) = 2").select(F.col("x").alias("cx"), F.col("y").alias("cy"), _opposite(F.col("dir")).alias("diag"), "steps")
    diag = F.col("diag")
    turned = inner.join(live, ["cx", "cy"]).where("contains(diag, line)").select(
        (F.col("cx") - _moved("x", diag, n)).alias("x"), (F.col("cy") - _moved("y", diag, n)).alias("y"), "x2", "y2", (n * geo.SCALED_DIAGONAL + k * geo.SCALE).alias("wt"), diag.alias("first"), line.alias("last")
    )
    return plain.unionByName(turned)


@dataclass
class CornerGraph:
    """edges(src, dst, wt, first, last) between corner cells, and the walks by which other cells are inserted."""

    edges: DataFrame
    table: DataFrame
    width: int


def corner_graph(cells: DataFrame, width: int) -> CornerGraph:
    """Corners joined by walks, diagonal and then straight, that meet no other corner; ends of queries are inserted.

    Shortest paths turn from straight to diagonal at corners only, so between
    two corners on one there is such a walk.
    """
    table = cut(walks(cells))
    hops = corner_hops(table, grid.corners(cells.select("x", "y", "ok")))
    return CornerGraph(cut(_as_edges(hops, width)), table, width)


def _as_edges(hops: DataFrame, width: int) -> DataFrame:
    return hops.select(geo.cell_id(F.col("x"), F.col("y"), width).alias("src"), geo.cell_id(F.col("x2"), F.col("y2"), width).alias("dst"), "wt", "first", "last")


def inserted(graph: CornerGraph, queries: DataFrame) -> DataFrame:
    """Edges of the starts and targets of queries (qid, sx, sy, tx, ty): from start -2 qid - 1, into target -2 qid - 2, and between them."""
    start, target = (-2 * F.col("qid") - 1), (-2 * F.col("qid") - 2)
    ends = lambda a, b: queries.select("qid", F.col(a).alias("x"), F.col(b).alias("y"))
    out = corner_hops(graph.table, ends("sx", "sy").select("x", "y").distinct()).join(ends("sx", "sy"), ["x", "y"])
    starts = out.select(start.alias("src"), geo.cell_id(F.col("x2"), F.col("y2"), graph.width).alias("dst"), "wt", "first", "last")
    goals = ends("tx", "ty").withColumnsRenamed({"x": "x2", "y": "y2"})
    into = target_hops(graph.table, ends("tx", "ty").select("x", "y").distinct()).join(goals, ["x2", "y2"])
    targets = into.select(geo.cell_id(F.col("x"), F.col("y"), graph.width).alias("src"), target.alias("dst"), "wt", "first", "last")
    at = [(geo.cell_id(F.col(f"{c}x"), F.col(f"{c}y"), graph.width), end) for c, end in (("s", start), ("t", target))]
    corners = graph.edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    same = [queries.select("qid", cell.alias("node")).join(corners, "node").select("node", end.alias("end")) for cell, end in at]
    none = [F.lit(None).cast("string").alias(c) for c in ("first", "last")]
    zero = F.lit(0).cast("bigint").alias("wt")
    on_corner = same[0].select(F.col("end").alias("src"), F.col("node").alias("dst"), zero, *none).unionByName(same[1].select(F.col("node").alias("src"), F.col("end").alias("dst"), zero, *none))
    return starts.unionByName(targets).unionByName(on_corner).unionByName(_direct(graph, queries))


def _direct(graph: CornerGraph, queries: DataFrame) -> DataFrame:
    """start to target, where a diagonal and then a straight walk meets it before any corner, or at one."""
    dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
    k, rest = F.least(F.abs(dx), F.abs(dy)), F.greatest(F.abs(dx), F.abs(dy)) - F.least(F.abs(dx), F.abs(dy))
    ns, ew = F.when(dy < 0, "N").when(dy > 0, "S").otherwise(""), F.when(dx < 0, "W").when(dx > 0, "E").otherwise("")
    wide = queries.select("qid", F.col("sx").alias("x"), F.col("sy").alias("y"), k.alias("k"), rest.alias("rest"), F.concat(ns, ew).alias("diag"), F.when(F.abs(dx) > F.abs(dy), ew).otherwise(ns).alias("line"))
    named = lambda c, n: graph.table.select("x", "y", F.col("dir").alias(c), F.col("steps").alias(n))
    known = wide.join(named("diag", "n1"), ["x", "y", "diag"], "left").where("k = 0 or n1 >= k")
    level = known.select("qid", "k", "rest", "diag", "line", (F.col("x") + _moved("x", F.col("diag"), F.col("k"))).alias("x"), (F.col("y") + _moved("y", F.col("diag"), F.col("k"))).alias("y"))
    free = graph.table.select("x", "y").distinct()
    met = level.join(free, ["x", "y"], "left_semi").join(named("line", "n2"), ["x", "y", "line"], "left").where("rest = 0 or n2 >= rest")
    wt = F.col("k") * geo.SCALED_DIAGONAL + F.col("rest") * geo.SCALE
    name = lambda c: F.when(c != "", c)
    first = name(F.when(F.col("k") > 0, F.col("diag")).otherwise(F.col("line")))
    return met.select((-2 * F.col("qid") - 1).alias("src"), (-2 * F.col("qid") - 2).alias("dst"), wt.alias("wt"), first.alias("first"), name(F.when(F.col("rest") > 0, F.col("line")).otherwise(F.col("diag"))).alias("last"))


def _ends(queries: DataFrame) -> DataFrame:
    return queries.select("qid", (-2 * F.col("qid") - 1).alias("source"), (-2 * F.col("qid") - 2).alias("target"))


def corner_costs(graph: CornerGraph, queries: DataFrame) -> DataFrame:
    """(qid, cost) of queries between cells over the corner graph; null where there is no path."""
    edges = cut(graph.edges.unionByName(inserted(graph, queries)))
    return search.point_to_point(edges.select("src", "dst", "wt"), _ends(queries)).select("qid", "cost")


def pruned_corner_costs(graph: CornerGraph, cells: DataFrame, queries: DataFrame) -> DataFrame:
    """The same, going on from a corner only in the directions that its arrival calls for: states are (node, direction of arrival)."""
    names = list(grid.DIRECTIONS)
    code = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, names)), c), F.lit(0)).cast("bigint")
    edges = cut(graph.edges.unionByName(inserted(graph, queries)))
    around = grid.neighbourhood(cells.select("x", "y", "ok")).where("ok").select(geo.cell_id(F.col("x"), F.col("y"), graph.width).alias("src"), "free")
    bits = F.coalesce(*(F.when(F.col("first") == n, F.lit(grid.DIRECTIONS[n][2])) for n in names), F.lit(_ALL))
    arrivals = edges.select(F.col("dst").alias("src"), F.col("last").alias("arrived")).distinct()
    known = edges.join(arrivals, "src").join(around, "src", "left")
    allowed = F.col("free").isNull() | F.col("first").isNull() | (successor_mask(F.col("free"), F.col("arrived")).bitwiseAND(bits) != 0)
    into = F.when(F.col("dst") < 0, 0).otherwise(code(F.col("last")))
    moves = known.where(allowed).select((F.col("src") * 16 + code(F.col("arrived"))).alias("src"), (F.col("dst") * 16 + into).alias("dst"), "wt")
    outset = edges.where("src < 0").select((F.col("src") * 16).alias("src"), (F.col("dst") * 16 + into).alias("dst"), "wt")
    ends = _ends(queries).select("qid", (F.col("source") * 16).alias("source"), (F.col("target") * 16).alias("target"))
    return search.point_to_point(cut(collapse(moves.unionByName(outset))), ends).select("qid", "cost")


def corner_hierarchy(graph: CornerGraph, percent: float = 80.0) -> tuple[DataFrame, DataFrame]:
    """(edges and shortcuts, ranks) of the corner graph; the corners that would go last are a core."""
    built, ranks = hierarchy.tile_contract(cut(collapse(graph.edges)), graph.width, percent)
    return cut(built), ranks


def corner_hierarchy_costs(graph: CornerGraph, contracted: tuple[DataFrame, DataFrame], queries: DataFrame) -> DataFrame:
    """(qid, cost, forward): the same over a ``corner_hierarchy``, from both ends and forward; inserted ends rank below all corners."""
    built, ranks = contracted
    extra = cut(collapse(inserted(graph, queries)).select("src", "dst", "wt", F.lit(None).cast("bigint").alias("via")))
    # Corners that no other corner is joined to.
    alone = extra.select(F.explode(F.array("src", "dst")).alias("node")).where("node >= 0").distinct().join(ranks, "node", "left_anti").select("node", F.lit(0).alias("rank"))
    ends = _ends(queries)
    low = ends.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(-1).alias("rank")), F.struct(F.col("target").alias("node"), F.lit(-2).alias("rank")))).alias("r")).select("r.*")
    whole, order = cut(built.unionByName(extra)), cut(ranks.unionByName(alone).unionByName(low))
    forward = hierarchy.forward_costs(whole, order, ends).select("qid", F.col("cost").alias("forward"))
    return hierarchy.query_costs(whole, order, ends).select("qid", "cost").join(forward, "qid")


class CornerHierarchy:
    """A grid's walks with the edges of its contracted corners as flat arrays: by cell number, climbing, falling, and falling turned round.

    The edges of cell p are those from ``first[i]`` to ``first[i + 1]``, i being ``index[p]``, or none where that is -1.
    """

    def __init__(self, walks: Jumps, built: DataFrame, ranks: DataFrame, width: int) -> None:
        self.walks, (h, w) = walks, walks.free.shape
        cell = lambda c: (F.floor(F.col(c) / width) + 1) * (w + 2) + F.col(c) % width + 1
        a, b = (ranks.select(F.col("node").alias(c), F.col("rank").alias(r)) for c, r in (("src", "r1"), ("dst", "r2")))
        rows = cut(built.join(a, "src").join(b, "dst").select(cell("src").cast("int").alias("src"), cell("dst").cast("int").alias("dst"), F.col("wt").cast("int").alias("wt"), F.signum(F.col("r2") - F.col("r1")).cast("byte").alias("way")))
        table = rows.toArrow()  # thirteen bytes an edge
        src, dst, wt, way = (table.column(c).to_numpy() for c in ("src", "dst", "wt", "way"))
        ids = np.unique(np.concatenate((src, dst)))
        self.index = np.full((h + 2) * (w + 2), -1, dtype=np.int32)
        self.index[ids] = np.arange(len(ids))

        def layout(tail: np.ndarray, head: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.flatnonzero(kept)
            order = order[np.argsort(tail[order], kind="stable")]
            return np.searchsorted(tail[order], np.append(ids, 2**31 - 1)).astype(np.int32), head[order], wt[order]

        self.up, self.down, self.back = layout(src, dst, way >= 0), layout(src, dst, way <= 0), layout(dst, src, way <= 0)


def _into(walks: Jumps, at: int) -> dict[int, int]:
    """The cells of ``target_hops`` of a cell, with their costs."""
    code, delta, out = walks.code, field(walks.free).delta, {}
    told = lambda p, cost: out.__setitem__(p, min(cost, out.get(p, cost)))
    for move in range(8):
        n = int(code[move, at])
        if n > 0:
            told(at + delta[move] * n, n * (geo.SCALE if move < 4 else geo.SCALED_DIAGONAL))
        if move < 4:
            for k in range(1, n if n > 0 else -n):
                for diag in (d for d in range(4, 8) if move in _PARTS[d]):
                    m = int(code[diag, at + delta[move] * k])
                    if m > 0:
                        told(at + delta[move] * k + delta[diag] * m, k * geo.SCALE + m * geo.SCALED_DIAGONAL)
    return out


def corner_hierarchy_search(domain: CornerHierarchy, start: Cell, goal: Cell, forward: bool = False) -> tuple[int | None, list]:
    """(cost, none) over a contracted corner graph, its ends inserted, guided by the empty-grid length: from both ends, or ``forward``, climbing and then falling."""
    walks, area = domain.walks, field(domain.walks.free)
    first, last, width = area.number(*start), area.number(*goal), area.width
    if not (area.free[first] and area.free[last]):
        return None, []
    index = memoryview(domain.index)
    outof, into = {}, _into(walks, last)
    for to, _, cost in hops_from(walks)(first, MOVES_OF[_ALL]):
        outof[to] = min(cost, outof.get(to, cost))
    for seeds, end in ((outof, first), (into, last)):
        if index[end] >= 0:
            seeds[end] = 0
    best = walk_to(walks, goal)(first)[1] if first != last else 0
    best = math.inf if best < 0 else best

    def bound(p: int, q: int) -> int:
        (y1, x1), (y2, x2) = divmod(p, width), divmod(q, width)
        x, y = abs(x1 - x2), abs(y1 - y2)
        return geo.SCALE * max(x, y) + (geo.SCALED_DIAGONAL - geo.SCALE) * min(x, y)

    # States are cell * 2 + 1 while climbing, cell * 2 when falling; a side is (open states, least costs, layouts by state, its goal).
    up, down, back = (tuple(memoryview(np.ascontiguousarray(c)) for c in layout) for layout in (domain.up, domain.down, domain.back))
    if forward:
        sides = [(outof, ([(down, 0)], [(up, 1), (down, 0)]), last)]
    else:
        sides = [(outof, ([], [(up, 1)]), last), (into, ([], [(back, 1)]), first)]
    costs, heaps = [], []
    for seeds, _, end in sides:
        costs.append({p * 2 + 1: g for p, g in seeds.items()})
        heaps.append([(g + bound(p, end), g, p * 2 + 1) for p, g in seeds.items()])
        heapq.heapify(heaps[-1])
    while any(heap and heap[0][0] < best for heap in heaps):
        for i, (_, ways, end) in enumerate(sides):
            if not heaps[i] or heaps[i][0][0] >= best:
                continue
            known = costs[i]
            _, g, state = heapq.heappop(heaps[i])
            if g > known[state]:
                continue
            at, climbing = divmod(state, 2)
            other = into.get(at) if forward else costs[1 - i].get(state)
            if other is not None and g + other < best:
                best = g + other
            j = index[at]
            if j < 0:
                continue
            for (begin, head, wt), falls in ways[climbing]:
                for e in range(begin[j], begin[j + 1]):
                    new, cost = head[e] * 2 + falls, g + wt[e]
                    if cost < known.get(new, math.inf):
                        known[new] = cost
                        over = cost + bound(head[e], end)
                        if over < best:
                            heapq.heappush(heaps[i], (over, cost, new))
    return (None if best == math.inf else int(best)), []
