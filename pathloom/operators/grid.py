"""Uniform grids as cell tables ``cells(x, y, ok)`` and what derives from them.

A missing neighbour is an obstacle, so no padding is stored.  Neighbourhoods
come from one scatter and one aggregation (every cell tells its eight
neighbours its state), not from eight self joins; scans along a line are
windows by row or column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import geometry as geo

# Name -> (dx, dy, bit); y grows downward.
DIRECTIONS = {"N": (0, -1, 1), "S": (0, 1, 2), "E": (1, 0, 4), "W": (-1, 0, 8), "NE": (1, -1, 16), "NW": (-1, -1, 32), "SE": (1, 1, 64), "SW": (-1, 1, 128)}
OBSTACLES = ("S", "W", "T", "@", "O")


def classified(tiles: DataFrame, rule: str = "obstacles") -> DataFrame:
    """cells with ``ok`` and terrain ``cost`` from (x, y, tile); rule ``obstacles`` or ``dots`` (only '.' is free)."""
    ok = ~F.col("tile").isin(*OBSTACLES) if rule == "obstacles" else F.col("tile") == "."
    return tiles.select(*tiles.columns, ok.alias("ok"), F.ascii("tile").alias("cost"))


def neighbourhood(cells: DataFrame) -> DataFrame:
    """cells with ``free``: a bit mask of the free ones among the eight around."""
    told = F.explode(F.array(*(F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(bit).alias("bit"), F.lit(False).alias("own"), F.lit(None).cast("boolean").alias("ok")) for dx, dy, bit in DIRECTIONS.values())))
    around = cells.where("ok").select(told.alias("t")).select("t.*")
    own = cells.select("x", "y", F.lit(0).alias("bit"), F.lit(True).alias("own"), "ok")
    both = own.unionByName(around).groupBy("x", "y").agg(F.bit_or("bit").alias("free"), F.max("own").alias("own"), F.max("ok").alias("ok"))
    return both.where("own").select("x", "y", "ok", "free")


def has(mask: Column, *names: str) -> Column:
    want = sum(DIRECTIONS[n][2] for n in names)
    return mask.bitwiseAND(F.lit(want)) == want


def lacks(mask: Column, *names: str) -> Column:
    return mask.bitwiseAND(F.lit(sum(DIRECTIONS[n][2] for n in names))) == 0


def steps(cells: DataFrame, diagonals: bool = True, straight: int = geo.SCALE, diagonal: int = geo.SCALED_DIAGONAL) -> DataFrame:
    """(x, y, x2, y2, dir, wt) of every legal step; a diagonal needs both straight cells beside it."""
    around = neighbourhood(cells).where("ok")
    moves = []
    for name, (dx, dy, _) in DIRECTIONS.items():
        if len(name) == 1 or diagonals:
            legal = has(F.col("free"), name, *(name if len(name) == 2 else ""))
            moves.append(F.when(legal, F.struct((F.col("x") + dx).alias("x2"), (F.col("y") + dy).alias("y2"), F.lit(name).alias("dir"), F.lit(straight if len(name) == 1 else diagonal).cast("bigint").alias("wt"))))
    return around.select("x", "y", F.explode(F.filter(F.array(*moves), lambda m: m.isNotNull())).alias("m")).select("x", "y", "m.*")


def to_graph(cells: DataFrame, width: int) -> DataFrame:
    """edges(src, dst, wt) over cell ids."""
    return steps(cells).select(geo.cell_id(F.col("x"), F.col("y"), width).alias("src"), geo.cell_id(F.col("x2"), F.col("y2"), width).alias("dst"), "wt")


def terrain_steps(cells: DataFrame) -> DataFrame:
    """(x, y, x2, y2, wt) with terrain costs: the mean of both cells, a diagonal √2 times the mean of all four.

    Weights are doubled (straight) and exact; diagonals are 141421 per 100000
    times the sum of four, doubled as well, so that integers stay comparable:
    every weight is 200000 times the cost.
    """
    by_cell = cells.where("ok").select("x", "y", "cost")
    base = steps(cells).select("x", "y", "x2", "y2", "dir")
    at = lambda i, x, y: by_cell.select(F.col("x").alias(x), F.col("y").alias(y), F.col("cost").alias(f"c{i}"))
    two = base.join(at(1, "x", "y"), ["x", "y"]).join(at(2, "x2", "y2"), ["x2", "y2"])
    straight = two.where(F.length("dir") == 1).select("x", "y", "x2", "y2", ((F.col("c1") + F.col("c2")) * 100_000).cast("bigint").alias("wt"))
    four = two.where(F.length("dir") == 2).join(at(3, "x2", "y"), ["x2", "y"]).join(at(4, "x", "y2"), ["x", "y2"])
    total = F.col("c1") + F.col("c2") + F.col("c3") + F.col("c4")
    return straight.unionByName(four.select("x", "y", "x2", "y2", F.floor(total * 70_710.5).cast("bigint").alias("wt")))


def labelled_steps(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Four-connected steps that cost the entered cell's label for the direction plus its own; labels(x, y, own, N, S, E, W)."""
    four = steps(cells, diagonals=False).select("x", "y", "x2", "y2", "dir")
    entered = labels.select(F.col("x").alias("x2"), F.col("y").alias("y2"), "own", *"NSEW")
    cost = F.col("own")
    pick = F.when(F.col("dir") == "N", F.col("N")).when(F.col("dir") == "S", F.col("S")).when(F.col("dir") == "E", F.col("E")).otherwise(F.col("W"))
    return four.join(entered, ["x2", "y2"]).select("x", "y", "x2", "y2", (cost + pick).alias("wt"))


def corners(cells: DataFrame) -> DataFrame:
    """Free cells beside a blocked diagonal whose two straight cells are free."""
    free = F.col("free")
    out = F.lit(False)
    for name in ("NE", "NW", "SE", "SW"):
        out = out | (lacks(free, name) & has(free, *name))
    return neighbourhood(cells).where(F.col("ok") & out).select("x", "y")


def _around_points(cells: DataFrame) -> DataFrame:
    """Lattice points (x, y) with ``mask``: bits of the free ones among the cells that meet there."""
    meets = F.explode(F.array(*(F.struct((F.col("x") + dx).alias("px"), (F.col("y") + dy).alias("py"), F.lit(bit).alias("bit")) for dx, dy, bit in ((0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8)))))
    mask = cells.select(meets.alias("m"), "ok").groupBy("m.px", "m.py").agg(F.bit_or(F.when(F.col("ok"), F.col("m.bit")).otherwise(0)).alias("mask"))
    return mask.select(F.col("px").alias("x"), F.col("py").alias("y"), "mask")


def points(cells: DataFrame) -> DataFrame:
    """Lattice points (x, y) with visible, corner and double_corner, from the four cells that meet there.

    A corner has exactly one blocked cell, a double corner two that touch
    diagonally; cells outside the grid are blocked.
    """
    n = F.bit_count(F.col("mask"))
    return _around_points(cells).select("x", "y", (n > 0).alias("visible"), (n == 3).alias("corner"), F.col("mask").isin(6, 9).alias("double_corner"))


def scan(cells: DataFrame, name: str) -> DataFrame:
    """cells with ``stop`` and ``dead_end`` along one straight direction.

    The walk stops at the first cell that is blocked (a dead end, counted to
    the cell before) or where a cell beside the line turns from blocked to
    free in the direction of travel.
    """
    dx, dy, _ = DIRECTIONS[name]
    along, across = ("x", "y") if dx else ("y", "x")
    back = {"E": "W", "W": "E", "N": "S", "S": "N"}[name]
    beside = ("N", "S") if dx else ("E", "W")
    diagonal = lambda side: (side + back) if dx else (back + side)
    around = neighbourhood(cells)
    turn = F.lit(False)
    for side in beside:
        turn = turn | (has(F.col("free"), side) & lacks(F.col("free"), diagonal(side)))
    flagged = around.withColumn("halt", F.when(~F.col("ok"), F.lit("wall")).when(turn, F.lit("turn")))
    forward = (dx or dy) > 0
    order = F.col(along).asc() if forward else F.col(along).desc()
    ahead = Window.partitionBy(across).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy(across)
    edge = (F.max(along).over(every) + 1) if forward else (F.min(along).over(every) - 1)
    place = F.when(F.col("halt").isNotNull(), F.struct(F.col(along).alias("at"), F.col("halt").alias("kind")))
    hit = F.first(place, ignorenulls=True).over(ahead)
    out = flagged.select("x", "y", "ok", edge.alias("edge"), hit.alias("hit")).where("ok")
    at = F.coalesce(F.col("hit.at"), F.col("edge"))
    dead = F.coalesce(F.col("hit.kind"), F.lit("wall")) == "wall"
    distance = F.abs(at - F.col(along)) - F.when(dead, 1).otherwise(0)
    return out.select("x", "y", F.lit(name).alias("dir"), distance.cast("bigint").alias("steps"), dead.alias("dead_end"))


def jump_table(cells: DataFrame) -> DataFrame:
    """(x, y, dir, steps, dead_end) for the four straight directions: jump distances of every free cell."""
    parts = [scan(cells, name) for name in "NSEW"]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def diagonal_jumps(cells: DataFrame) -> DataFrame:
    """(x, y, dir, steps, dead_end) for the four diagonal directions.

    A diagonal walk stops where the step is legal and the cell entered has a
    forced turn or a straight jump that is no dead end; the walk is a window
    along the diagonal, over its legal prefix.
    """
    around = neighbourhood(cells)
    straight = jump_table(cells).where("not dead_end").groupBy("x", "y").agg(F.collect_set("dir").alias("live"))
    base = around.join(straight, ["x", "y"], "left").withColumn("live", F.coalesce("live", F.array().cast("array<string>")))
    out = None
    for name in ("NE", "NW", "SE", "SW"):
        dx, dy, _ = DIRECTIONS[name]
        v, h = name[0], name[1]
        ov, oh = {"N": "S", "S": "N"}[v], {"E": "W", "W": "E"}[h]
        forced = (lacks(F.col("free"), oh) & has(F.col("free"), v, v + oh)) | (lacks(F.col("free"), ov) & has(F.col("free"), h, ov + h))
        live = F.array_contains("live", v) | F.array_contains("live", h)
        entered = F.col("ok") & has(F.col("free"), ov, oh, ov + oh)  # the step into this cell is legal
        halt = F.when(~entered, "wall").when(forced | live, "stop")
        flagged = base.select("x", "y", "ok", (F.col("x") * dy - F.col("y") * dx).alias("line"), (F.col("x") * dx).alias("along"), halt.alias("halt"))
        ahead = Window.partitionBy("line").orderBy("along").rowsBetween(1, Window.unboundedFollowing)
        every = Window.partitionBy("line")
        hit = F.first(F.when(F.col("halt").isNotNull(), F.struct(F.col("along").alias("at"), F.col("halt").alias("kind"))), ignorenulls=True).over(ahead)
        rows = flagged.select("x", "y", "ok", "along", (F.max("along").over(every) + 1).alias("edge"), hit.alias("hit")).where("ok")
        dead = F.coalesce(F.col("hit.kind"), F.lit("wall")) == "wall"
        part = rows.select("x", "y", F.lit(name).alias("dir"), (F.coalesce("hit.at", "edge") - F.col("along") - F.when(dead, 1).otherwise(0)).cast("bigint").alias("steps"), dead.alias("dead_end"))
        out = part if out is None else out.unionByName(part)
    return out


def jump_graph(cells: DataFrame, width: int) -> DataFrame:
    """Edges between a free cell and the stops of its straight jumps, both ways, with scaled weights."""
    hops = jump_table(cells).where("not dead_end")
    x2 = F.col("x") + F.when(F.col("dir") == "E", F.col("steps")).when(F.col("dir") == "W", -F.col("steps")).otherwise(0)
    y2 = F.col("y") + F.when(F.col("dir") == "S", F.col("steps")).when(F.col("dir") == "N", -F.col("steps")).otherwise(0)
    one = hops.join(corners(cells), ["x", "y"]).select(geo.cell_id(F.col("x"), F.col("y"), width).alias("src"), geo.cell_id(x2, y2, width).alias("dst"), (F.col("steps") * geo.SCALE).alias("wt"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "wt")).distinct()


def rescale(cells: DataFrame, old_w: int, old_h: int, new_w: int, new_h: int) -> DataFrame:
    """The grid at another size; every new cell takes the nearest old one's state."""
    spark = cells.sparkSession
    new = spark.range(new_w * new_h).select((F.col("id") % new_w).alias("nx"), F.floor(F.col("id") / new_w).alias("ny"))
    old = new.select("nx", "ny", F.floor(F.col("nx") * old_w / new_w).alias("x"), F.floor(F.col("ny") * old_h / new_h).alias("y"))
    return old.join(cells.select("x", "y", "ok"), ["x", "y"], "left").select(F.col("nx").alias("x"), F.col("ny").alias("y"), F.coalesce("ok", F.lit(False)).alias("ok"))


def roughened(cells: DataFrame, seed: int, percent: int = 25) -> DataFrame:
    """Every free cell turns into rough terrain with a chance that depends on its place and the seed alone."""
    chance = F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("x").cast("string"), F.col("y").cast("string"))), 1, 4)
    return cells.withColumn("rough", F.col("ok") & (chance < f"{percent * 65536 // 100:04x}"))


def point_steps(cells: DataFrame) -> DataFrame:
    """(x, y, x2, y2, wt, pinched) of moves between lattice points: along a side of a free cell, or across a free cell.

    ``pinched`` points, where obstacles touch, are left only by a search that starts there.
    """
    mask = _around_points(cells)
    # The cells at each side of a point, by their bits in the mask.
    at = {"N": ("ne", "nw"), "S": ("se", "sw"), "E": ("ne", "se"), "W": ("nw", "sw"), "NE": ("ne",), "NW": ("nw",), "SE": ("se",), "SW": ("sw",)}
    bits = {"se": 1, "sw": 2, "ne": 4, "nw": 8}
    moves = []
    for name, (dx, dy, _) in DIRECTIONS.items():
        open_ = F.col("mask").bitwiseAND(F.lit(sum(bits[c] for c in at[name]))) > 0
        moves.append(F.when(open_, F.struct((F.col("x") + dx).alias("x2"), (F.col("y") + dy).alias("y2"), F.lit(geo.SCALE if len(name) == 1 else geo.SCALED_DIAGONAL).cast("bigint").alias("wt"))))
    every = mask.select("x", "y", F.explode(F.filter(F.array(*moves), lambda m: m.isNotNull())).alias("m"), F.col("mask").isin(6, 9).alias("pinched"))
    return every.select("x", "y", "m.x2", "m.y2", "m.wt", "pinched")


def clusters(cells: DataFrame, size: int = 10) -> DataFrame:
    """cells with the coordinates (cx, cy) of their square cluster."""
    return cells.select("*", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))


def entrances(cells: DataFrame, size: int = 10, long_run: int = 6) -> DataFrame:
    """(x, y, x2, y2) of transitions over the east and south borders of clusters.

    A run of cells free on both sides has one in its middle, or one at each
    end if it is long; runs are islands by difference of place and rank.
    """
    free = cells.where("ok").select("x", "y")
    out = None
    for dx, dy, along, fixed in ((1, 0, "y", "x"), (0, 1, "x", "y")):
        other = free.select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"))
        both = free.join(other, ["x", "y"]).where(F.col(fixed) % size == size - 1).withColumn("block", F.floor(F.col(along) / size))
        rank = F.row_number().over(Window.partitionBy(fixed, "block").orderBy(along))
        runs = both.withColumn("island", F.col(along) - rank).groupBy(fixed, "block", "island").agg(F.min(along).alias("lo"), F.max(along).alias("hi"))
        n = F.col("hi") - F.col("lo") + 1
        picks = F.when(n >= long_run, F.array("lo", "hi")).otherwise(F.array(F.floor((F.col("lo") + F.col("hi")) / 2)))
        part = runs.select(fixed, F.explode(picks).alias(along))
        part = part.select("x", "y", (F.col("x") + dx).alias("x2"), (F.col("y") + dy).alias("y2"))
        out = part if out is None else out.unionByName(part)
    return out
