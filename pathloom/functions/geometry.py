"""Scalar geometry as columns; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cost of a diagonal step as floating point and as fixed point per 100000, and tolerances.
DIAGONAL = 1.414213562
SCALE = 100_000
SCALED_DIAGONAL = 141_421
GRID_EPS = 1e-7
MESH_EPS = 1e-8


def cell_id(x: Column, y: Column, width: Column | int) -> Column:
    return y * width + x


def cell_x(cell: Column, width: Column | int) -> Column:
    return cell % width


def cell_y(cell: Column, width: Column | int) -> Column:
    return F.floor(cell / width).cast("bigint")


def octile(x1: Column, y1: Column, x2: Column, y2: Column, straight: int = SCALE, diagonal: int = SCALED_DIAGONAL) -> Column:
    """Cost over an empty eight-connected grid, in fixed point."""
    dx, dy = F.abs(x1 - x2), F.abs(y1 - y2)
    return F.least(dx, dy) * diagonal + (F.greatest(dx, dy) - F.least(dx, dy)) * straight


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, eps: float = MESH_EPS) -> Column:
    """1 where c lies left of a to b, -1 right, 0 on the line."""
    turn = cross(bx - ax, by - ay, cx - ax, cy - ay)
    return F.when(F.abs(turn) <= eps, 0).when(turn > 0, 1).otherwise(-1)


def line_parameter(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """How far along a to b the line through c and d crosses; null for parallel lines."""
    down = cross(bx - ax, by - ay, dx - cx, dy - cy)
    return F.when(F.abs(down) <= MESH_EPS, None).otherwise(cross(cx - ax, cy - ay, dx - cx, dy - cy) / down)


def reflect(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct<x, y>: the point mirrored at the line through a and b."""
    ux, uy = bx - ax, by - ay
    t = ((px - ax) * ux + (py - ay) * uy) / (ux * ux + uy * uy)
    return F.struct((2 * (ax + t * ux) - px).alias("x"), (2 * (ay + t * uy) - py).alias("y"))


def double_area(ring: Column) -> Column:
    """Twice the signed area of an array<struct<x, y>> in order."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, turned, lambda a, b: cross(a["x"], a["y"], b["x"], b["y"]).cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def interval_bound(rx: Column, ry: Column, left: Column, right: Column, row: Column, tx: Column, ty: Column) -> Column:
    """Least length from a root through a horizontal interval to a target.

    A target on the root's side of the row is mirrored; the path goes straight
    where the line meets the interval, else over the nearer end.
    """
    my = F.when((ry - row) * (ty - row) > 0, 2 * row - ty).otherwise(ty)
    at = F.when(F.abs(my - ry) <= GRID_EPS, F.when(F.abs(ry - row) <= GRID_EPS, F.greatest(left, F.least(right, tx))).otherwise(rx)).otherwise(
        rx + (row - ry) * (tx - rx) / (my - ry)
    )
    inside = F.greatest(left, F.least(right, at))
    return euclidean(rx, ry, inside, row) + euclidean(inside, row, tx, my)


def segment_bound(rx: Column, ry: Column, lx: Column, ly: Column, qx: Column, qy: Column, tx: Column, ty: Column) -> Column:
    """Least length from a root over the segment from its left end l to its right end q to a target, in any direction.

    A target on the root's side is mirrored; the path goes straight where both
    ends leave it room, else over the end that does not.
    """
    same = cross(lx - qx, ly - qy, rx - qx, ry - qy) * cross(lx - qx, ly - qy, tx - qx, ty - qy) > 0
    image = reflect(tx, ty, qx, qy, lx, ly)
    gx, gy = F.when(same, image["x"]).otherwise(tx), F.when(same, image["y"]).otherwise(ty)
    right = cross(qx - rx, qy - ry, gx - rx, gy - ry) < 0
    left = cross(lx - rx, ly - ry, gx - rx, gy - ry) > 0
    over = lambda px, py: euclidean(rx, ry, px, py) + euclidean(px, py, gx, gy)
    return F.when(right, over(qx, qy)).when(left, over(lx, ly)).otherwise(euclidean(rx, ry, gx, gy))


def travel_direction(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Compass name of the first step, diagonal steps first; y grows downward."""
    ns = F.when(y2 < y1, "N").when(y2 > y1, "S").otherwise("")
    ew = F.when(x2 > x1, "E").when(x2 < x1, "W").otherwise("")
    return F.concat(ns, ew)


def box_contains(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return x.between(x1, x2) & y.between(y1, y2)


def boxes_meet(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    return (ax1 <= bx2) & (bx1 <= ax2) & (ay1 <= by2) & (by1 <= ay2)


def fixed_weight(cost: Column) -> Column:
    """A cost as a truncated fixed-point weight."""
    return (cost * SCALE).cast("bigint")
