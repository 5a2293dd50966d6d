"""Polygon meshes as vertex and polygon tables; point location by binned equi-joins."""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import geometry as geo
from pathloom.plans.lineage import cut


def unit_mesh(cells: DataFrame, width: int) -> DataFrame:
    """(pid, ring, neighbours) with one square per free cell, counter-clockwise; -1 is an obstacle."""
    free = cells.where("ok").select("x", "y")
    x, y = F.col("x"), F.col("y")
    ring = F.array(*(F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))))
    told = F.explode(F.array(*(F.struct((x - dx).alias("x"), (y - dy).alias("y"), F.lit(i).alias("i"), geo.cell_id(x, y, width).alias("id")) for i, (dx, dy) in enumerate(((0, -1), (1, 0), (0, 1), (-1, 0))))))
    beside = free.select(told.alias("t")).groupBy("t.x", "t.y").agg(*(F.max(F.when(F.col("t.i") == i, F.col("t.id"))).alias(f"n{i}") for i in range(4)))
    out = free.join(beside, ["x", "y"], "left")
    return out.select(geo.cell_id(x, y, width).alias("pid"), ring.alias("ring"), F.array(*(F.coalesce(f"n{i}", F.lit(-1)) for i in range(4))).alias("neighbours"))


def rings(polygons: DataFrame, vertices: DataFrame) -> DataFrame:
    """(pid, ring) of polygons that name their vertices."""
    corner = polygons.select("pid", F.posexplode("vertices").alias("i", "vid")).join(vertices.select("vid", "x", "y"), "vid")
    ordered = F.sort_array(F.collect_list(F.struct("i", "x", "y")))
    return corner.groupBy("pid").agg(F.transform(ordered, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("ring"))


def inside(ring: Column, x: Column, y: Column, eps: float = geo.MESH_EPS) -> Column:
    """Whether a convex counter-clockwise ring holds the point, its border included."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.forall(F.zip_with(ring, turned, lambda a, b: geo.cross(b["x"] - a["x"], b["y"] - a["y"], x - a["x"], y - a["y"])), lambda c: c >= -eps)


def place_in(ring: Column, x: Column, y: Column, eps: float = geo.MESH_EPS) -> Column:
    """vertex, edge or inside, for a point that a ring holds."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    vertex = F.exists(ring, lambda p: (F.abs(p["x"] - x) <= eps) & (F.abs(p["y"] - y) <= eps))
    edge = F.exists(F.zip_with(ring, turned, lambda a, b: geo.cross(b["x"] - a["x"], b["y"] - a["y"], x - a["x"], y - a["y"])), lambda c: F.abs(c) <= eps)
    return F.when(vertex, "vertex").when(edge, "edge").otherwise("inside")


def binned(polygons: DataFrame, size: float = 1.0, parts: int = 1) -> DataFrame:
    """(pid, ring, x1, y1, x2, y2, level, bx, by): every polygon with its box in the bins that this touches, on the level that is as wide as the box.

    Bins of level k are ``size * 2**k / parts`` wide, so with one part a polygon of any size is in four bins at most, or some more for one
    that ends at borders; with more parts it is in more bins, which hold fewer others.
    """
    low = lambda c: F.array_min(F.transform("ring", lambda p: p[c])) - geo.MESH_EPS
    high = lambda c: F.array_max(F.transform("ring", lambda p: p[c])) + geo.MESH_EPS
    boxes = polygons.select("pid", "ring", low("x").alias("x1"), low("y").alias("y1"), high("x").alias("x2"), high("y").alias("y2"))
    wide = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(size))
    level = boxes.withColumn("level", F.ceil(F.log2(wide / size)).cast("int")).withColumn("width", F.lit(size / parts) * F.pow(F.lit(2.0), F.col("level")))
    span = lambda c: F.sequence(F.floor(F.col(f"{c}1") / F.col("width")), F.floor(F.col(f"{c}2") / F.col("width")))
    box = ["pid", "ring", "x1", "y1", "x2", "y2", "level"]
    return level.select(*box, F.explode(span("x")).alias("bx"), span("y").alias("ys")).select(*box, "bx", F.explode("ys").alias("by"))


def locate(points: DataFrame, polygons: DataFrame, size: float = 1.0, crowded: bool = False) -> DataFrame:
    """(points..., pid, place): the smallest polygon (pid, ring) that holds each point (id, x, y) and where in it the point
    is: inside, edge or vertex; a point that no polygon holds has no pid and is outside.

    Points meet polygons by bin on every level that has polygons; levels are
    few, as each doubles the width.  Both are moved to their bins: Spark takes
    the bins for no larger than the file that the polygons come from, and would
    gather them at the driver.  ``crowded`` is for polygons that overlap
    and points and polygons of which many are equal: each different place is
    sought once, each different ring has its smallest pid, and bins are finer.
    """
    if crowded:
        places = points.select("x", "y").distinct().withColumn("id", F.struct("x", "y"))
        found = _smallest(places, cut(polygons.groupBy("ring").agg(F.min("pid").alias("pid"))), size, crowded=True)
        if found is not None:
            found = found.select(F.col("id.x").alias("x"), F.col("id.y").alias("y"), "pid", "place")
    else:
        found = _smallest(points.select("id", "x", "y"), polygons, size)
    if found is None:
        return points.withColumns({"pid": F.lit(None).cast(polygons.schema["pid"].dataType), "place": F.lit("outside")})
    return points.join(found, ["x", "y"] if crowded else "id", "left").select(*points.columns, "pid", F.coalesce("place", F.lit("outside")).alias("place"))


def _smallest(points: DataFrame, polygons: DataFrame, size: float, crowded: bool = False) -> DataFrame | None:
    """(id, pid, place) of the points that a polygon holds; None where there are no polygons."""
    parts = 4 if crowded else 1
    bins = binned(polygons, size, parts)
    levels = sorted(r["level"] for r in bins.select("level").distinct().collect())  # the logarithm of the largest box
    if not levels:
        return None
    width = F.lit(size / parts) * F.pow(F.lit(2.0), F.col("level"))
    at = points.select("id", "x", "y", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    at = at.select("id", "x", "y", "level", F.floor(F.col("x") / width).alias("bx"), F.floor(F.col("y") / width).alias("by"))
    boxed = F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))
    bins = bins if crowded else bins.hint("merge")
    met = at.join(bins, ["level", "bx", "by"]).where(boxed & inside(F.col("ring"), F.col("x"), F.col("y")))
    place = place_in(F.col("ring"), F.col("x"), F.col("y"))
    held = met.groupBy("id").agg(F.min(F.struct("pid", place.alias("place"))).alias("s"))
    return held.select("id", F.col("s.pid").alias("pid"), F.col("s.place").alias("place"))


def best_rectangles(free: np.ndarray) -> np.ndarray:
    """Disjoint rectangles, as rows (x, y, w, h), that cover the free cells, taken greedily by min(w, h) * w * h.

    Sequential by nature: one grid is one task.  A cell's best rectangle ends
    there at its bottom right; stale entries are scored again when they come
    up, for less.  Cells of one score are in order of x and y, eight bytes each.
    """
    h, w = free.shape
    left = [bytearray(row.tobytes()) for row in (free > 0).astype(np.uint8)]

    def best(x: int, y: int) -> tuple[int, int, int]:
        found, wide, tall = (0, 0, 0), w, 0
        for row in range(y, -1, -1):
            line, run = left[row], 0
            while run < wide and x - run >= 0 and line[x - run]:
                run += 1
            if run == 0:
                break
            wide, tall = run, tall + 1
            found = max(found, (min(wide, tall) * wide * tall, wide, tall))
        return found

    scored: dict[int, array] = {}
    told = lambda score, x, y: scored.setdefault(score, array("q")).append(x * h + y)
    for y in range(h):
        for x in range(w):
            if left[y][x]:
                told(best(x, y)[0], x, y)
    out = array("i")
    while scored:
        score = max(scored)
        for code in np.sort(np.frombuffer(scored.pop(score), dtype=np.int64)):
            x, y = divmod(int(code), h)
            if not left[y][x]:
                continue
            now, rw, rh = best(x, y)
            if now != score:
                told(now, x, y)
                continue
            for row in range(y - rh + 1, y + 1):
                left[row][x - rw + 1 : x + 1] = bytes(rw)
            out.extend((x - rw + 1, y - rh + 1, rw, rh))
    return np.array(out, dtype=np.int32).reshape(-1, 4)


def grown_rectangles(free: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Disjoint rectangles (x, y, w, h): from each free cell in order a square grows, then the wider or higher one of larger area, width on ties."""
    left = free.astype(bool).copy()
    h, w = left.shape
    clear = lambda x, y, a, b: x + a <= w and y + b <= h and bool(left[y : y + b, x : x + a].all())
    out = []
    for y in range(h):
        for x in range(w):
            if not left[y, x]:
                continue
            n = 1
            while clear(x, y, n + 1, n + 1):
                n += 1
            wide, tall = n, n
            while clear(x, y, wide + 1, n):
                wide += 1
            while clear(x, y, n, tall + 1):
                tall += 1
            a, b = (wide, n) if wide * n >= n * tall else (n, tall)
            left[y : y + b, x : x + a] = False
            out.append((x, y, a, b))
    return out
