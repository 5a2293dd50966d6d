"""Queries over the grid of parts, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import geometry as geo
from pathloom.functions import scalars
from pathloom.operators import grid, kernels, mesh
from pathloom.plans import shapes
from pathloom.plans.shapes import GRID

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


_D = {"N": (0, -1), "S": (0, 1), "E": (1, 0), "W": (-1, 0), "NE": (1, -1), "NW": (-1, -1), "SE": (1, 1), "SW": (-1, 1)}


def _free(x: str, y: str) -> str:
    return f"EXISTS (SELECT 1 FROM f WHERE f.x = {x} AND f.y = {y})"


def _steps(names) -> str:
    out = []
    for n in names:
        dx, dy = _D[n]
        sides = f" JOIN f s1 ON s1.x = a.x + {dx} AND s1.y = a.y JOIN f s2 ON s2.x = a.x AND s2.y = a.y + {dy}" if len(n) == 2 else ""
        out.append(f"SELECT a.x, a.y, b.x AS x2, b.y AS y2, '{n}' AS dir, CAST({100_000 if len(n) == 1 else 141_421} AS BIGINT) AS wt FROM f a JOIN f b ON b.x = a.x + {dx} AND b.y = a.y + {dy}{sides}")
    return " UNION ALL ".join(out)


@query(f"WITH {GRID} SELECT x, y, tile, tile NOT IN ('S','W','T','@','O') AS ok, tile = '.' AS dot, ascii(tile) AS cost FROM c")
def grid_cells(spark, sf_dir):
    """Tiles under both obstacle rules, and terrain cost."""
    tiles = shapes.grid(spark, sf_dir).select("x", "y", "tile")
    return grid.classified(tiles).select("*", (F.col("tile") == ".").alias("dot"))


@query(f"WITH {GRID} {_steps(_D)}")
def grid_steps(spark, sf_dir):
    """Eight-connected steps without cutting corners."""
    return grid.steps(shapes.grid(spark, sf_dir).select("x", "y", "ok"))


@query(f"WITH {GRID} {_steps('NSEW')}")
def grid_steps_four(spark, sf_dir):
    return grid.steps(shapes.grid(spark, sf_dir).select("x", "y", "ok"), diagonals=False)


@query(f"WITH {GRID}, s AS ({_steps(_D)}) SELECT y * w + x AS src, y2 * w + x2 AS dst, wt FROM s, w")
def grid_graph(spark, sf_dir):
    """The grid as a graph over cell ids with fixed-point weights."""
    return grid.to_graph(shapes.grid(spark, sf_dir).select("x", "y", "ok"), shapes.grid_width(spark, sf_dir))


@query(f"""WITH {GRID}, s AS ({_steps(_D)}), k AS (SELECT x, y, cost FROM c WHERE ok)
SELECT s.x, s.y, s.x2, s.y2, (a.cost + b.cost) * 100000 AS wt FROM s JOIN k a ON a.x = s.x AND a.y = s.y JOIN k b ON b.x = s.x2 AND b.y = s.y2 WHERE length(dir) = 1
UNION ALL SELECT s.x, s.y, s.x2, s.y2, CAST(floor((a.cost + b.cost + p.cost + q.cost) * 70710.5) AS BIGINT) FROM s JOIN k a ON a.x = s.x AND a.y = s.y JOIN k b ON b.x = s.x2 AND b.y = s.y2
JOIN k p ON p.x = s.x2 AND p.y = s.y JOIN k q ON q.x = s.x AND q.y = s.y2 WHERE length(dir) = 2""")
def terrain_steps(spark, sf_dir):
    """Steps weighted by terrain."""
    return grid.terrain_steps(shapes.grid(spark, sf_dir).select("x", "y", "ok", "cost"))


@query(f"""WITH {GRID}, s AS ({_steps('NSEW')}) SELECT s.x, s.y, s.x2, s.y2, b.cost + CASE dir WHEN 'N' THEN b.x % 3 WHEN 'S' THEN b.y % 3 WHEN 'E' THEN (b.x + b.y) % 3 ELSE 1 END AS wt FROM s JOIN c b ON b.x = s.x2 AND b.y = s.y2""")
def labelled_steps(spark, sf_dir):
    """Steps that cost edge and vertex labels."""
    cells = shapes.grid(spark, sf_dir)
    labels = cells.select("x", "y", F.col("cost").alias("own"), (F.col("x") % 3).alias("N"), (F.col("y") % 3).alias("S"), ((F.col("x") + F.col("y")) % 3).alias("E"), F.lit(1).cast("bigint").alias("W"))
    return grid.labelled_steps(cells.select("x", "y", "ok"), labels)


@query(f"WITH {GRID} SELECT x, y FROM f a WHERE " + " OR ".join(
    f"(NOT {_free(f'a.x + {_D[n][0]}', f'a.y + {_D[n][1]}')} AND {_free(f'a.x + {_D[n][0]}', 'a.y')} AND {_free('a.x', f'a.y + {_D[n][1]}')})" for n in ("NE", "NW", "SE", "SW")))
def grid_corners(spark, sf_dir):
    """Corner cells."""
    return grid.corners(shapes.grid(spark, sf_dir).select("x", "y", "ok"))


@query(f"""WITH {GRID}, m AS (SELECT x + dx AS x, y + dy AS y, CASE WHEN ok THEN bit ELSE 0 END AS bit FROM c, (VALUES (0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8)) d(dx, dy, bit)),
p AS (SELECT x, y, CAST(sum(bit) AS BIGINT) AS mask FROM m GROUP BY ALL) SELECT x, y, mask > 0 AS visible, bit_count(mask) = 3 AS corner, mask IN (6, 9) AS double_corner FROM p""")
def lattice_points(spark, sf_dir):
    """Lattice points by the cells around them."""
    return grid.points(shapes.grid(spark, sf_dir).select("x", "y", "ok"))


def _scan_sql(name: str) -> str:
    dx, dy = _D[name]
    along, across = ("x", "y") if dx else ("y", "x")
    sides = [(0, -1), (0, 1)] if dx else [(1, 0), (-1, 0)]
    turn = " OR ".join(f"({_free(f'c.x + {sx}', f'c.y + {sy}')} AND NOT {_free(f'c.x + {sx} - {dx}', f'c.y + {sy} - {dy}')})" for sx, sy in sides)
    up = (dx or dy) > 0
    pick, edge = ("min", f"max({along}) + 1") if up else ("max", f"min({along}) - 1")
    order = "ASC" if up else "DESC"
    return f"""SELECT x, y, '{name}' AS dir, CAST(abs(coalesce(hit, edge) - {along}) - CASE WHEN dead THEN 1 ELSE 0 END AS BIGINT) AS steps, dead AS dead_end FROM (
 SELECT x, y, ok, hit, edge, hit IS NULL OR NOT EXISTS (SELECT 1 FROM f WHERE f.{along} = hit AND f.{across} = h.{across}) AS dead FROM (
  SELECT x, y, ok, {pick}(CASE WHEN halt THEN {along} END) OVER (PARTITION BY {across} ORDER BY {along} {order} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hit, edge FROM (
   SELECT c.x, c.y, c.ok, NOT c.ok OR {turn} AS halt, e.edge FROM c JOIN (SELECT {across} AS k, {edge} AS edge FROM c GROUP BY 1) e ON e.k = c.{across})) h) WHERE ok"""


@query(f"WITH {GRID} " + " UNION ALL ".join(_scan_sql(n) for n in "NSEW"))
def jump_table(spark, sf_dir):
    """Straight jump distances of every free cell."""
    return grid.jump_table(shapes.grid(spark, sf_dir).select("x", "y", "ok"))


def _diagonal_sql() -> str:
    """Walks along diagonals while steps are legal, to the first cell with a live straight jump in a direction of the diagonal."""
    names = ("NE", "NW", "SE", "SW")
    legal = " UNION ALL ".join(f"SELECT a.x, a.y, '{n}' AS dir, a.x + {_D[n][0]} AS nx, a.y + {_D[n][1]} AS ny FROM f a WHERE " + " AND ".join(_free(f"a.x + {dx}", f"a.y + {dy}") for dx, dy in ((_D[n][0], _D[n][1]), (_D[n][0], 0), (0, _D[n][1]))) for n in names)
    live = " UNION ALL ".join(f"SELECT DISTINCT x, y, '{n}' AS dir FROM j WHERE NOT dead_end AND dir IN ('{n[0]}', '{n[1]}')" for n in names)
    return f"""WITH RECURSIVE {GRID}, j AS ({" UNION ALL ".join(_scan_sql(n) for n in "NSEW")}), lg AS ({legal}), lv AS ({live}),
wk(x, y, dir, cx, cy, steps, hit) AS (SELECT x, y, dir, x, y, CAST(0 AS BIGINT), false FROM f, (VALUES ('NE'), ('NW'), ('SE'), ('SW')) v(dir)
UNION ALL SELECT wk.x, wk.y, wk.dir, lg.nx, lg.ny, wk.steps + 1, lv.x IS NOT NULL FROM wk JOIN lg ON lg.x = wk.cx AND lg.y = wk.cy AND lg.dir = wk.dir LEFT JOIN lv ON lv.x = lg.nx AND lv.y = lg.ny AND lv.dir = wk.dir WHERE NOT wk.hit)
SELECT x, y, dir, max(steps) AS steps, NOT bool_or(hit) AS dead_end FROM wk GROUP BY x, y, dir"""


@query(_diagonal_sql())
def diagonal_jumps(spark, sf_dir):
    """Diagonal jump distances of every free cell."""
    return grid.diagonal_jumps(shapes.grid(spark, sf_dir).select("x", "y", "ok"))


@query(f"""WITH {GRID}, j AS ({" UNION ALL ".join(_scan_sql(n) for n in "NSEW")}), k AS ({ORACLES["grid_corners"].split(GRID)[1].strip()}),
o AS (SELECT j.y * w + j.x AS src, (j.y + CASE dir WHEN 'S' THEN steps WHEN 'N' THEN -steps ELSE 0 END) * w + j.x + CASE dir WHEN 'E' THEN steps WHEN 'W' THEN -steps ELSE 0 END AS dst, steps * 100000 AS wt
FROM j JOIN k ON k.x = j.x AND k.y = j.y, w WHERE NOT dead_end) SELECT DISTINCT src, dst, wt FROM (SELECT * FROM o UNION ALL SELECT dst, src, wt FROM o)""")
def jump_graph(spark, sf_dir):
    """Corners joined to the stops of their straight jumps."""
    return grid.jump_graph(shapes.grid(spark, sf_dir).select("x", "y", "ok"), shapes.grid_width(spark, sf_dir))


@query(f"WITH {GRID} SELECT nx AS x, ny AS y, coalesce(ok, false) AS ok FROM (SELECT CAST(i % 32 AS BIGINT) AS nx, CAST(i // 32 AS BIGINT) AS ny, i % 32 * w // 32 AS x, i // 32 * w // 32 AS y FROM range(1024) r(i), w) LEFT JOIN c USING (x, y)")
def grid_rescaled(spark, sf_dir):
    """The grid at 32 by 32."""
    w = shapes.grid_width(spark, sf_dir)
    return grid.rescale(shapes.grid(spark, sf_dir).select("x", "y", "ok"), w, w, 32, 32)


@query(f"WITH {GRID} SELECT x // 10 AS cx, y // 10 AS cy, count(*) AS n, count(*) FILTER (ok) AS free FROM c GROUP BY ALL")
def grid_clusters(spark, sf_dir):
    """Cells and free cells of square clusters."""
    return grid.clusters(shapes.grid(spark, sf_dir)).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("free"))


def _entrance_sql(dx: int, dy: int) -> str:
    along, fixed = ("y", "x") if dx else ("x", "y")
    x, y = (fixed, "p") if dx else ("p", fixed)
    return f"""SELECT {x} AS x, {y} AS y, {x} + {dx} AS x2, {y} + {dy} AS y2 FROM (SELECT {fixed}, unnest(CASE WHEN hi - lo + 1 >= 6 THEN [lo, hi] ELSE [(lo + hi) // 2] END) AS p FROM (
SELECT {fixed}, b, g, min({along}) AS lo, max({along}) AS hi FROM (SELECT x, y, {along} // 10 AS b, {along} - row_number() OVER (PARTITION BY {fixed}, {along} // 10 ORDER BY {along}) AS g
FROM f a WHERE {fixed} % 10 = 9 AND {_free(f'a.x + {dx}', f'a.y + {dy}')}) GROUP BY ALL))"""


@query(f"WITH {GRID} {_entrance_sql(1, 0)} UNION ALL {_entrance_sql(0, 1)}")
def cluster_entrances(spark, sf_dir):
    """Transitions over cluster borders."""
    return grid.entrances(shapes.grid(spark, sf_dir).select("x", "y", "ok"))


@query(f"""WITH {GRID} SELECT x, y, y * w + x AS id, least(abs(x - 7), abs(y - 3)) * 141421 + (greatest(abs(x - 7), abs(y - 3)) - least(abs(x - 7), abs(y - 3))) * 100000 AS octile,
abs(x - 7) + abs(y - 3) AS manhattan, round(sqrt((x - 7) * (x - 7) + (y - 3) * (y - 3)), 6) AS euclidean,
CASE WHEN 3 < y THEN 'N' WHEN 3 > y THEN 'S' ELSE '' END || CASE WHEN 7 > x THEN 'E' WHEN 7 < x THEN 'W' ELSE '' END AS dir, x BETWEEN 2 AND 9 AND y BETWEEN 1 AND 5 AS inside FROM c, w""")
def grid_heuristics(spark, sf_dir):
    """Cell ids, distances to a goal, direction of travel and box test."""
    w, x, y, gx, gy = shapes.grid_width(spark, sf_dir), F.col("x"), F.col("y"), F.lit(7), F.lit(3)
    return shapes.grid(spark, sf_dir).select(
        "x", "y", geo.cell_id(x, y, w).alias("id"), geo.octile(x, y, gx, gy).alias("octile"), geo.manhattan(x, y, gx, gy).alias("manhattan"),
        F.round(geo.euclidean(x, y, gx, gy), 6).alias("euclidean"), geo.travel_direction(x, y, gx, gy).alias("dir"), geo.box_contains(x, y, F.lit(2), F.lit(1), F.lit(9), F.lit(5)).alias("inside"),
    )


@query(f"""WITH {GRID}, g AS (SELECT x, y, CAST(x AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py FROM c)
SELECT x, y, CASE WHEN abs((10 - 0) * (py - 0) - (5 - 0) * (px - 0)) <= 1e-8 THEN 0 WHEN (10 - 0) * py - 5 * px > 0 THEN 1 ELSE -1 END AS side,
round(2 * ((px * 10 + py * 5) / 125.0) * 10 - px, 6) AS rx, round(2 * ((px * 10 + py * 5) / 125.0) * 5 - py, 6) AS ry FROM g""")
def line_geometry(spark, sf_dir):
    """Orientation towards a line and the mirror image at it."""
    px, py, o = F.col("x").cast("double"), F.col("y").cast("double"), F.lit(0.0)
    m = geo.reflect(px, py, o, o, F.lit(10.0), F.lit(5.0))
    return shapes.grid(spark, sf_dir).select("x", "y", geo.orientation(o, o, F.lit(10.0), F.lit(5.0), px, py).alias("side"), F.round(m["x"], 6).alias("rx"), F.round(m["y"], 6).alias("ry"))


@query("SELECT l_orderkey, l_linenumber, floor(abs(l_quantity) / 7 + 0.5) * 7 * sign(l_quantity) AS nearest, CASE WHEN l_shipdate IS NULL THEN NULL WHEN l_returnflag || l_linestatus = 'NO' THEN 'open' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'closed' END AS kind FROM lineitem")
def result_scalars(spark, sf_dir):
    """Rounding to multiples and ordered pattern rules."""
    lines = shapes.table(spark, sf_dir, "lineitem")
    name = F.concat("l_returnflag", "l_linestatus")
    rules = [("^R", "returned"), ("^NO$", "open")]
    return lines.select("l_orderkey", "l_linenumber", scalars.round_to(F.col("l_quantity"), 7).alias("nearest"), F.when(F.col("l_shipdate").isNotNull(), scalars.classify(name, rules, "closed")).alias("kind"))


@query(f"""WITH {GRID}, n AS (SELECT x, y, y * w + x AS id FROM f, w)
SELECT a.id AS pid, coalesce(n0.id, -1) AS n0, coalesce(n1.id, -1) AS n1, coalesce(n2.id, -1) AS n2, coalesce(n3.id, -1) AS n3 FROM n a
LEFT JOIN n n0 ON n0.x = a.x AND n0.y = a.y - 1 LEFT JOIN n n1 ON n1.x = a.x + 1 AND n1.y = a.y LEFT JOIN n n2 ON n2.x = a.x AND n2.y = a.y + 1 LEFT JOIN n n3 ON n3.x = a.x - 1 AND n3.y = a.y""")
def unit_mesh(spark, sf_dir):
    """One square polygon per free cell with its neighbours."""
    built = mesh.unit_mesh(shapes.grid(spark, sf_dir).select("x", "y", "ok"), shapes.grid_width(spark, sf_dir))
    return built.select("pid", *(F.col("neighbours")[i].alias(f"n{i}") for i in range(4)))


@query(f"""WITH {GRID}, p AS (SELECT o_orderkey AS id, (o_custkey * 13 % (w * 4)) / 4.0 AS x, (o_orderkey * 7 % (w * 4)) / 4.0 AS y FROM orders, w)
SELECT p.id, min(f.y * w + f.x) AS pid FROM p CROSS JOIN w LEFT JOIN f ON f.x IN (floor(p.x), ceil(p.x) - 1) AND f.y IN (floor(p.y), ceil(p.y) - 1) GROUP BY 1""")
def point_location(spark, sf_dir):
    """The polygon that holds each of a table of points."""
    w = shapes.grid_width(spark, sf_dir)
    orders = shapes.table(spark, sf_dir, "orders")
    points = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 13 % (w * 4) / 4).alias("x"), (F.col("o_orderkey") * 7 % (w * 4) / 4).alias("y"))
    return mesh.locate(points, mesh.unit_mesh(shapes.grid(spark, sf_dir).select("x", "y", "ok"), w)).select("id", "pid")


@query("""WITH r AS (SELECT p_partkey AS pid, p_partkey * 17 % 211 AS x0, p_partkey * 31 % 197 AS y0, 1 + p_size % 10 AS w, 1 + p_size * 3 % 10 AS h FROM part),
p AS (SELECT o_orderkey AS id, (o_custkey * 13 + o_orderkey) % 880 / 4 AS x, o_orderkey * 7 % 820 / 4 AS y FROM orders),
m AS (SELECT id, x, y, min(pid) AS pid FROM p JOIN r ON x BETWEEN x0 AND x0 + w AND y BETWEEN y0 AND y0 + h GROUP BY ALL)
SELECT p.id, m.pid, CASE WHEN m.pid IS NULL THEN 'outside' WHEN p.x IN (x0, x0 + w) AND p.y IN (y0, y0 + h) THEN 'vertex' WHEN p.x IN (x0, x0 + w) OR p.y IN (y0, y0 + h) THEN 'edge' ELSE 'inside' END AS place
FROM p LEFT JOIN m ON m.id = p.id LEFT JOIN r ON r.pid = m.pid""")
def point_classes(spark, sf_dir):
    """Where points lie among rectangles of 1 to 100 cells that overlap: the smallest that holds each, and its class there."""
    key, size = F.col("p_partkey"), F.col("p_size")
    box = shapes.table(spark, sf_dir, "part").select(key.alias("pid"), (key * 17 % 211).alias("x"), (key * 31 % 197).alias("y"), (1 + size % 10).alias("w"), (1 + size * 3 % 10).alias("h"))
    corner = lambda dx, dy: F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y"))
    none = F.lit(0)
    rings = box.select("pid", F.array(corner(none, none), corner(F.col("w"), none), corner(F.col("w"), F.col("h")), corner(none, F.col("h"))).alias("ring"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    points = shapes.table(spark, sf_dir, "orders").select(o.alias("id"), ((c * 13 + o) % 880 / 4).alias("x"), (o * 7 % 820 / 4).alias("y"))
    return mesh.locate(points, rings, crowded=True).select("id", "pid", "place")
