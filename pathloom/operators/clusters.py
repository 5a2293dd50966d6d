"""Searches over clusters of a grid: square clusters with an abstract graph, and empty rectangles."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import geometry as geo
from pathloom.operators import grid, search
from pathloom.operators.graph import collapse
from pathloom.operators.kernels import MAX_CELLS, MOVES, MOVES_OF, field, octile, run_queries
from pathloom.operators.mesh import grown_rectangles
from pathloom.plans.lineage import cut


def _inner_edges(cells: DataFrame, width: int, size: int) -> DataFrame:
    """Steps that stay in their cluster."""
    block = lambda c: F.floor(F.col(c) / size)
    inner = grid.steps(cells).where((block("x") == block("x2")) & (block("y") == block("y2")))
    return inner.select(geo.cell_id(F.col("x"), F.col("y"), width).alias("src"), geo.cell_id(F.col("x2"), F.col("y2"), width).alias("dst"), "wt")


def _between(cells: DataFrame, width: int, size: int) -> DataFrame:
    """Edges over the borders of clusters, both ways."""
    across = grid.entrances(cells, size)
    one = across.select(geo.cell_id(F.col("x"), F.col("y"), width).alias("src"), geo.cell_id(F.col("x2"), F.col("y2"), width).alias("dst"), F.lit(geo.SCALE).cast("bigint").alias("wt"))
    return cut(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "wt")))


#: Numbers of the distance tables that a task holds at once, about.
TABLE = 1 << 20


def _distances(free: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least costs [i, y, x] inside blocks ``free`` [i, y, x] from ``starts`` (y, x), one for each; -1 where no way is."""
    n, h, w = free.shape
    pad = np.zeros((n, h + 2, w + 2), dtype=bool)
    pad[:, 1:-1, 1:-1] = free
    at = lambda a, dx, dy: a[:, 1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx]
    enters = [free & at(pad, -dx, -dy) & at(pad, -dx, 0) & at(pad, 0, -dy) for dx, dy in MOVES]  # the step into a cell is legal
    none = np.iinfo(np.int64).max // 2
    far = np.full(pad.shape, none)
    far[np.arange(n), starts[:, 0] + 1, starts[:, 1] + 1] = 0
    while True:
        best = at(far, 0, 0).copy()
        for (dx, dy), legal in zip(MOVES, enters, strict=True):
            np.minimum(best, np.where(legal, at(far, -dx, -dy) + octile(abs(dx), abs(dy)), none), out=best)
        if (best == at(far, 0, 0)).all():
            return np.where(best < none, best, -1)
        far[:, 1:-1, 1:-1] = best


def inner_ways(cells: DataFrame, nodes: DataFrame, width: int, size: int) -> DataFrame:
    """(src, dst, wt): the least costs inside clusters between all ``nodes`` (column node, free cells) of one.

    A row is a cluster with the places of its free cells and nodes; a task takes tables of distances of many at a time.
    """
    block, place = lambda c: F.floor(c / size), lambda x, y: ((y % size) * size + x % size).cast("int")
    x, y = F.col("node") % width, F.floor(F.col("node") / width)
    held = cells.where("ok").groupBy(block(F.col("x")).alias("cx"), block(F.col("y")).alias("cy")).agg(F.collect_list(place(F.col("x"), F.col("y"))).alias("free"))
    told = nodes.groupBy(block(x).alias("cx"), block(y).alias("cy")).agg(F.collect_list(place(x, y)).alias("nodes"))
    at_once = max(1, TABLE // (size * size))

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [len(n) for n in batch["nodes"]]
            row, spot = np.repeat(np.arange(len(batch)), held), np.concatenate([np.asarray(n, dtype=np.int64) for n in batch["nodes"]])
            last, cx, cy = np.cumsum(held), batch["cx"].to_numpy(), batch["cy"].to_numpy()
            for low in range(0, len(row), at_once):
                mine = slice(low, low + at_once)
                mine_row, mine_spot = row[mine], spot[mine]
                base = mine_row[0]
                free = np.zeros((mine_row[-1] - base + 1, size * size), dtype=bool)
                for i in range(len(free)):
                    free[i, batch["free"].iloc[base + i]] = True
                far = _distances(free[mine_row - base].reshape(-1, size, size), np.stack((mine_spot // size, mine_spot % size), axis=1)).reshape(len(mine_row), -1)
                # Every start beside all nodes of its cluster.
                n = np.asarray(held)[mine_row]
                i = np.repeat(np.arange(len(mine_row)), n)
                to = spot[np.repeat(last[mine_row] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                wt = far[i, to]
                cell = lambda r, s: (cy[r] * size + s // size) * width + cx[r] * size + s % size
                out = pd.DataFrame({"src": cell(mine_row[i], mine_spot[i]), "dst": cell(mine_row[i], to), "wt": wt})
                yield out[(wt > 0)]

    return held.join(told, ["cx", "cy"]).mapInPandas(ways, "src bigint, dst bigint, wt bigint")


def abstract_graph(cells: DataFrame, width: int, size: int = 10, ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges(src, dst, wt), trees): transitions between clusters, and ways inside clusters between all that are their nodes.

    ``ends`` (column node) are cells inserted beside the transitions, as
    starts and targets of queries are.  ``trees`` (qid = node, node, g, pred) hold the ways inside.
    """
    cells = cells.select("x", "y", "ok")
    between = _between(cells, width, size)
    nodes = between.select(F.col("src").alias("node"))
    nodes = cut((nodes if ends is None else nodes.unionByName(ends.select("node"))).distinct())
    trees = cut(search.relax(cut(_inner_edges(cells, width, size)), nodes.select(F.col("node").alias("qid"), "node")))
    inside = trees.join(nodes, "node").where("qid <> node").select(F.col("qid").alias("src"), F.col("node").alias("dst"), F.col("g").alias("wt"))
    return cut(collapse(between.unionByName(inside))), trees


def _end_nodes(cells: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """(qid, source, target) of queries (qid, sx, sy, tx, ty) whose ends are free; the others have nulls."""
    free = cells.where("ok").select(geo.cell_id(F.col("x"), F.col("y"), width).alias("node"), F.lit(True).alias("free"))
    ids = queries.select("qid", geo.cell_id(F.col("sx"), F.col("sy"), width).alias("s"), geo.cell_id(F.col("tx"), F.col("ty"), width).alias("t"))
    wide = ids.join(free.select(F.col("node").alias("s"), F.col("free").alias("a")), "s", "left").join(free.select(F.col("node").alias("t"), F.col("free").alias("b")), "t", "left")
    return wide.select("qid", F.when(F.col("a") & F.col("b"), F.col("s")).alias("source"), F.when(F.col("a") & F.col("b"), F.col("t")).alias("target"))


def hierarchical_costs(cells: DataFrame, width: int, queries: DataFrame, size: int = 10) -> DataFrame:
    """(qid, cost) over the abstract graph, queries inserted; near the least cost, null where there is no path.

    The graph is broadcast and each task searches it for a few queries; one with more than ``MAX_CELLS`` edges is relaxed.
    """
    cells = cells.select("x", "y", "ok")
    ends = cut(_end_nodes(cells, queries, width))
    valid = ends.where("source is not null")
    between = _between(cells, width, size)
    nodes = cut(between.select(F.col("src").alias("node")).unionByName(valid.select(F.explode(F.array("source", "target")).alias("node"))).distinct())
    edges = cut(collapse(between.unionByName(inner_ways(cells, nodes, width, size))))
    if width * width > MAX_CELLS or edges.count() > MAX_CELLS:
        found = search.point_to_point(edges, valid).select("qid", "cost")
        return ends.select("qid").join(found, "qid", "left")
    found = run_queries(queries, Abstract(nodes, edges, width), abstract_search, paths=False)
    return found.select("qid", F.col("cost").cast("bigint").alias("cost"))


class Abstract:
    """An abstract graph as flat arrays: the edges of node i are those from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, width: int) -> None:
        column = lambda table, name: table.column(name).to_numpy()
        self.ids = np.sort(column(nodes.select(F.col("node").cast("int")).toArrow(), "node"))
        rows = edges.select(*(F.col(c).cast("int").alias(c) for c in ("src", "dst", "wt"))).toArrow()  # twelve bytes an edge
        tail = np.searchsorted(self.ids, column(rows, "src"))
        order = np.argsort(tail, kind="stable")
        self.first = np.searchsorted(tail[order], np.arange(len(self.ids) + 1))
        self.head = np.searchsorted(self.ids, column(rows, "dst")).astype(np.int32)[order]
        self.wt, self.width = column(rows, "wt")[order], width

    def number(self, x: int, y: int) -> int:
        """The node's number; -1 for cells that are none."""
        cell = y * self.width + x
        i = int(np.searchsorted(self.ids, cell))
        return i if 0 <= x < self.width and i < len(self.ids) and self.ids[i] == cell else -1


def abstract_search(graph: Abstract, start: tuple[int, int], goal: tuple[int, int]) -> tuple[int | None, list]:
    """(cost, nothing) of the least path over an abstract graph whose nodes have the ends, by cost plus octile distance."""
    source, target = graph.number(*start), graph.number(*goal)
    if source < 0 or target < 0:
        return None, []
    dx, dy = np.abs(graph.ids % graph.width - goal[0]).astype(np.int64), np.abs(graph.ids // graph.width - goal[1]).astype(np.int64)
    ahead = np.minimum(dx, dy) * octile(1, 1) + np.abs(dx - dy) * octile(1, 0)
    first, head, wt = graph.first, graph.head, graph.wt
    g, closed = {source: 0}, set()
    heap = [(0, source)]
    while heap:
        _, at = heapq.heappop(heap)
        if at in closed:
            continue
        if at == target:
            return g[at], []
        closed.add(at)
        mine, done = slice(first[at], first[at + 1]), g[at]
        to = head[mine]
        for node, price, rest in zip(to.tolist(), wt[mine].tolist(), ahead[to].tolist(), strict=True):
            cost = done + price
            if node not in closed and cost < g.get(node, math.inf):
                g[node] = cost
                heapq.heappush(heap, (cost + rest, node))
    return None, []


def hierarchical_paths(cells: DataFrame, width: int, queries: DataFrame, size: int = 10) -> DataFrame:
    """(qid, cost, path): the same, refined to single steps (cell ids) by the ways inside clusters."""
    valid = cut(_end_nodes(cells, queries, width).where("source is not null"))
    edges, trees = abstract_graph(cells, width, size, valid.select(F.explode(F.array("source", "target")).alias("node")))
    found = cut(search.relax(edges, valid.select("qid", F.col("source").alias("node"))))
    coarse = search.extract_paths(found, valid.join(found.select("qid", F.col("node").alias("target"), F.col("g").alias("cost")), ["qid", "target"]).select("qid", "target"))
    hops = coarse.select("qid", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("pos", "src"), "path").select("qid", "pos", "src", F.expr("path[pos + 1]").alias("dst"))
    hops = cut(hops)
    ways = search.extract_paths(trees.select("qid", "node", "pred"), hops.select(F.col("src").alias("qid"), F.col("dst").alias("target")).distinct().join(trees.select("qid", F.col("node").alias("target")), ["qid", "target"], "left_semi"))
    full = hops.join(ways.select(F.col("qid").alias("src"), F.col("target").alias("dst"), F.col("path").alias("way")), ["src", "dst"], "left")
    # Of each way all but its first cell; a step between clusters is its own way.
    parts = full.select("qid", F.struct("pos", F.when(F.col("way").isNull(), F.array("dst")).otherwise(F.expr("slice(way, 2, size(way))")).alias("way")).alias("part"))
    joined = parts.groupBy("qid").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["way"])).alias("rest"))
    cost = found.join(valid.select("qid", F.col("target").alias("node")), ["qid", "node"]).select("qid", F.col("g").alias("cost"))
    out = valid.join(cost, "qid").join(joined, "qid", "left")
    return out.select("qid", "cost", F.concat(F.array("source"), F.coalesce("rest", F.expr("cast(array() as array<bigint>)"))).alias("path"))


def cluster_metrics(cells: DataFrame, size: int = 10) -> DataFrame:
    """(clusters, mean_cells, widest, transitions, mean_transitions) of the square clusters that have free cells."""
    held = grid.clusters(cells.where("ok"), size).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x") + 1).alias("w"))
    doors = grid.entrances(cells, size)
    block = lambda c: F.floor(F.col(c) / size)
    sides = doors.select(F.explode(F.array(F.struct(block("x").alias("cx"), block("y").alias("cy")), F.struct(block("x2").alias("cx"), block("y2").alias("cy")))).alias("c")).groupBy("c.cx", "c.cy").agg(F.count(F.lit(1)).alias("doors"))
    return held.join(sides, ["cx", "cy"], "left").agg(
        F.count(F.lit(1)).alias("clusters"), F.avg("n").alias("mean_cells"), F.max("w").alias("widest"),
        F.sum(F.coalesce("doors", F.lit(0))).alias("transitions"), F.avg(F.coalesce("doors", F.lit(0))).alias("mean_transitions"),
    )


class Rectangles:
    """Disjoint empty rectangles that cover a grid's free cells, and the cells on their borders."""

    def __init__(self, free: np.ndarray) -> None:
        self.free = free
        self.boxes = grown_rectangles(free)
        self.of = np.full(free.shape, -1, dtype=np.int32)
        for i, (x, y, w, h) in enumerate(self.boxes):
            self.of[y : y + h, x : x + w] = i
        self._box = np.array(self.boxes, dtype=np.int32).reshape(-1, 4)

    def __getstate__(self) -> dict:
        return {"free": self.free, "of": self.of, "_box": self._box}

    def border(self, i: int) -> list[tuple[int, int]]:
        x, y, w, h = self._box[i].tolist()
        ends = (y, y + h - 1) if h > 1 else (y,)
        return [(a, b) for a in range(x, x + w) for b in (range(y, y + h) if a in (x, x + w - 1) else ends)]

    def metrics(self) -> dict[str, float]:
        sizes = [w * h for _, _, w, h in self.boxes]
        return {"rectangles": len(sizes), "mean_cells": sum(sizes) / len(sizes) if sizes else 0.0, "pruned": sum(max(0, w - 2) * max(0, h - 2) for _, _, w, h in self.boxes)}


def rectangle_search(area: Rectangles, start: tuple[int, int], goal: tuple[int, int]) -> tuple[int | None, list]:
    """(cost, path) that crosses rectangles by single macro edges between border cells.

    Inside a rectangle nothing blocks, so a macro edge costs the octile
    distance; a cell that was reached from its own rectangle goes on only to
    others, and both ends in one rectangle are one edge.
    """
    flat = field(area.free)
    if not (flat.free[flat.number(*start)] and flat.free[flat.number(*goal)]):
        return None, []
    far = lambda a, b: octile(abs(a[0] - b[0]), abs(a[1] - b[1]))
    own = lambda p: area.of.item(p[1], p[0])
    if own(start) == own(goal):
        return far(start, goal), [start, goal] if start != goal else [start]

    def successors(at: tuple[int, int], before: tuple[int, int] | None):
        mine = own(at)
        if before is None or own(before) != mine:
            yield from area.border(mine)
            if own(goal) == mine:
                yield goal
        for i in MOVES_OF[flat.legal[flat.number(*at)]]:
            to = (at[0] + MOVES[i][0], at[1] + MOVES[i][1])
            if own(to) != mine:
                yield to

    g, parent, closed = {start: 0}, {start: None}, set()
    heap = [(far(start, goal), 0, start)]
    while heap:
        _, _, at = heapq.heappop(heap)
        if at in closed:
            continue
        closed.add(at)
        if at == goal:
            path, cost = [], g[at]
            while at is not None:
                path.append(at)
                at = parent[at]
            return cost, path[::-1]
        for to in successors(at, parent[at]):
            cost = g[at] + far(at, to)
            if to != at and cost < g.get(to, math.inf):
                g[to], parent[to] = cost, at
                heapq.heappush(heap, (cost + far(to, goal), -cost, to))
    return None, []
