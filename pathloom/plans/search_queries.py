"""Queries that search the grid of parts, with oracles that relax the same steps in SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import geometry as geo
from pathloom.operators import clusters, grid, intervals, jumps, kernels, mesh, search, workload
from pathloom.plans import shapes
from pathloom.plans.grid_queries import _D, _entrance_sql, _free, _steps
from pathloom.plans.lineage import cut
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


#: Queries between cells, one for each supplier.
_ENDS = "q AS (SELECT s_suppkey AS qid, (s_suppkey * 7 + 1) % w AS sx, (s_suppkey * 11 + 3) % w AS sy, (s_suppkey * 13 + 5) % w AS tx, (s_suppkey * 17 + 7) % w AS ty FROM supplier, w)"


def least(edges: str, starts: str, name: str = "d") -> str:
    """A recursive CTE of least costs (source, node, g) over ``edges`` (src, dst, wt) from ``starts`` (source)."""
    return f"""{name}(source, node, g) USING KEY (source, node) AS (SELECT DISTINCT source, source AS node, CAST(0 AS BIGINT) AS g FROM {starts}
UNION SELECT x.source, x.node, x.g FROM (SELECT o.source, e.dst AS node, min(o.g + e.wt) AS g FROM {name} o JOIN {edges} e ON e.src = o.node GROUP BY 1, 2) x
LEFT JOIN recurring.{name} r ON r.source = x.source AND r.node = x.node WHERE r.g IS NULL OR x.g < r.g)"""


def _costs(steps: str, cost: str = "CAST(d.g AS DOUBLE)") -> str:
    """Costs of the queries over ``steps`` (x, y, x2, y2, wt); null where an end is blocked or no path is."""
    return f"""WITH RECURSIVE {GRID}, {_ENDS}, st AS ({steps}), e AS (SELECT y * w + x AS src, y2 * w + x2 AS dst, wt FROM st, w),
b AS (SELECT qid, q.sy * w + q.sx AS source, q.ty * w + q.tx AS target FROM q JOIN f s ON s.x = q.sx AND s.y = q.sy JOIN f t ON t.x = q.tx AND t.y = q.ty, w),
{least('e', 'b')} SELECT q.qid, {cost} AS cost FROM q LEFT JOIN b USING (qid) LEFT JOIN d ON d.source = b.source AND d.node = b.target"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = shapes.grid_width(spark, sf_dir)
    at = lambda a, b: ((F.col("s_suppkey") * a + b) % w)
    return shapes.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), at(7, 1).alias("sx"), at(11, 3).alias("sy"), at(13, 5).alias("tx"), at(17, 7).alias("ty"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.grid(spark, sf_dir).select("x", "y", "ok")


def _run(spark: SparkSession, sf_dir: str, kernel, domain=None) -> DataFrame:
    domain = kernels.grid_array(_cells(spark, sf_dir)) if domain is None else domain
    return kernels.run_queries(_queries(spark, sf_dir), domain, kernel, paths=False).select("qid", "cost")


@query(_costs(_steps(_D)))
def astar_search(spark, sf_dir):
    """A* with eight moves."""
    return _run(spark, sf_dir, kernels.astar)


@query(_costs(_steps("NSEW")))
def four_connected_search(spark, sf_dir):
    """A* with four moves."""
    return _run(spark, sf_dir, lambda free, a, b: kernels.astar(free, a, b, moves=4))


@query(_costs(_steps(_D)))
def jump_point_search(spark, sf_dir):
    """Jump points found by scanning, in the directions that the arrival calls for."""
    return _run(spark, sf_dir, jumps.online)


@query(_costs(_steps(_D)))
def jump_point_search_through(spark, sf_dir):
    """The same without stops on diagonals."""
    return _run(spark, sf_dir, lambda free, a, b: jumps.online(free, a, b, through=True))


def _jumps(spark: SparkSession, sf_dir: str) -> jumps.Jumps:
    cells = cut(_cells(spark, sf_dir))
    return jumps.jumps_of(cells, grid.jump_table(cells).unionByName(grid.diagonal_jumps(cells)))


@query(_costs(_steps(_D)))
def jump_table_search(spark, sf_dir):
    """Jump points read from the table of jump distances."""
    return _run(spark, sf_dir, jumps.offline, _jumps(spark, sf_dir))


@query(_costs(_steps(_D)))
def jump_table_search_through(spark, sf_dir):
    return _run(spark, sf_dir, lambda domain, a, b: jumps.offline(domain, a, b, through=True), _jumps(spark, sf_dir))


@query(_costs(_steps(_D)))
def rectangle_search(spark, sf_dir):
    """Search over empty rectangles with macro edges between their borders."""
    return _run(spark, sf_dir, clusters.rectangle_search, clusters.Rectangles(kernels.grid_array(_cells(spark, sf_dir))))


_VALID = f" WHERE {_free('q.sx', 'q.sy')} AND {_free('q.tx', 'q.ty')}"


def _valid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose ends are both free."""
    free = _cells(spark, sf_dir).where("ok")
    one = _queries(spark, sf_dir).join(free.select(F.col("x").alias("sx"), F.col("y").alias("sy")), ["sx", "sy"], "left_semi")
    return cut(one.join(free.select(F.col("x").alias("tx"), F.col("y").alias("ty")), ["tx", "ty"], "left_semi").select("qid", "sx", "sy", "tx", "ty"))


def _corner_searches(spark: SparkSession, sf_dir: str, pruned: bool = False) -> DataFrame | None:
    """One search for each different query over broadcast walks; None where the grid has too many cells."""
    if shapes.grid_width(spark, sf_dir) ** 2 > kernels.MAX_CELLS:
        return None
    walks = jumps.walks_of(_cells(spark, sf_dir))
    found = kernels.run_queries(_valid_queries(spark, sf_dir), walks, lambda domain, a, b: jumps.corner_search(domain, a, b, pruned), paths=False)
    return found.select("qid", F.col("cost").cast("bigint").alias("cost"))


@query(_costs(_steps(_D), "d.g") + _VALID)
def corner_graph_search(spark, sf_dir):
    """Searches over the graph of corners, with starts and targets inserted; the graph is relaxed where the grid is too large to broadcast."""
    if (found := _corner_searches(spark, sf_dir)) is not None:
        return found
    graph = jumps.corner_graph(_cells(spark, sf_dir), shapes.grid_width(spark, sf_dir))
    return workload.once(_valid_queries(spark, sf_dir), lambda queries: jumps.corner_costs(graph, queries))


@query(_costs(_steps(_D), "d.g") + _VALID)
def pruned_corner_search(spark, sf_dir):
    """The same in the directions that the arrival calls for."""
    if (found := _corner_searches(spark, sf_dir, pruned=True)) is not None:
        return found
    cells = _cells(spark, sf_dir)
    graph = jumps.corner_graph(cells, shapes.grid_width(spark, sf_dir))
    return workload.once(_valid_queries(spark, sf_dir), lambda queries: jumps.pruned_corner_costs(graph, cells, queries))


_ABSTRACT = f"""WITH RECURSIVE {GRID}, {_ENDS}, s AS ({_steps(_D)}), door AS ({_entrance_sql(1, 0)} UNION ALL {_entrance_sql(0, 1)}),
inner_e AS (SELECT y * w + x AS src, y2 * w + x2 AS dst, wt FROM s, w WHERE x // 10 = x2 // 10 AND y // 10 = y2 // 10),
b AS (SELECT qid, q.sy * w + q.sx AS source, q.ty * w + q.tx AS target FROM q JOIN f s ON s.x = q.sx AND s.y = q.sy JOIN f t ON t.x = q.tx AND t.y = q.ty, w),
hop AS (SELECT y * w + x AS src, y2 * w + x2 AS dst FROM door, w UNION ALL SELECT y2 * w + x2, y * w + x FROM door, w),
nd AS (SELECT DISTINCT source FROM (SELECT src AS source FROM hop UNION ALL SELECT source FROM b UNION ALL SELECT target FROM b)),
{least('inner_e', 'nd', 'i')},
e AS (SELECT src, dst, min(wt) AS wt FROM (SELECT src, dst, CAST(100000 AS BIGINT) AS wt FROM hop UNION ALL SELECT i.source, i.node, i.g FROM i JOIN nd ON nd.source = i.node WHERE i.node <> i.source) GROUP BY 1, 2),
{least('e', 'b')} SELECT q.qid, d.g AS cost FROM q LEFT JOIN b USING (qid) LEFT JOIN d ON d.source = b.source AND d.node = b.target"""


@query(_ABSTRACT)
def hierarchical_search(spark, sf_dir):
    """Costs over the abstract graph of square clusters."""
    return clusters.hierarchical_costs(_cells(spark, sf_dir), shapes.grid_width(spark, sf_dir), _queries(spark, sf_dir))


@query(f"""WITH {GRID}, door AS ({_entrance_sql(1, 0)} UNION ALL {_entrance_sql(0, 1)}),
h AS (SELECT x // 10 AS cx, y // 10 AS cy, count(*) AS n, max(x) - min(x) + 1 AS wide FROM f GROUP BY 1, 2),
o AS (SELECT cx, cy, count(*) AS doors FROM (SELECT x // 10 AS cx, y // 10 AS cy FROM door UNION ALL SELECT x2 // 10, y2 // 10 FROM door) GROUP BY 1, 2)
SELECT count(*) AS clusters, round(avg(n), 6) AS mean_cells, max(wide) AS widest, CAST(sum(coalesce(doors, 0)) AS BIGINT) AS transitions, round(avg(coalesce(doors, 0)), 6) AS mean_transitions FROM h LEFT JOIN o USING (cx, cy)""")
def cluster_metrics(spark, sf_dir):
    out = clusters.cluster_metrics(_cells(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_cells", "mean_transitions")})


_POINT_STEPS = f"""mv AS (SELECT DISTINCT f.x + ax AS x, f.y + ay AS y, f.x + bx AS x2, f.y + by_ AS y2, CASE WHEN ax = bx OR ay = by_ THEN 100000 ELSE 141421 END AS wt
FROM f, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) a(ax, ay), (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) b(bx, by_) WHERE ax <> bx OR ay <> by_),
pm AS (SELECT x + dx AS x, y + dy AS y, sum(CASE WHEN ok THEN bit ELSE 0 END) AS mask FROM c, (VALUES (0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8)) v(dx, dy, bit) GROUP BY 1, 2)"""


@query(f"WITH {GRID}, {_POINT_STEPS} SELECT mv.x, mv.y, x2, y2, CAST(wt AS BIGINT) AS wt, mask IN (6, 9) AS pinched FROM mv JOIN pm ON pm.x = mv.x AND pm.y = mv.y")
def point_steps(spark, sf_dir):
    """Moves between lattice points."""
    return grid.point_steps(_cells(spark, sf_dir))


@query(f"""WITH RECURSIVE {GRID}, {_ENDS}, {_POINT_STEPS}, pe AS (SELECT mv.y * (w + 1) + mv.x AS p, y2 * (w + 1) + x2 AS r, CAST(wt AS BIGINT) AS wt, mask IN (6, 9) AS pinched FROM mv JOIN pm ON pm.x = mv.x AND pm.y = mv.y, w),
b AS (SELECT qid, sy * (w + 1) + sx AS source, ty * (w + 1) + tx AS target FROM q, w),
d(source, node, g) USING KEY (source, node) AS (SELECT DISTINCT source, source AS node, CAST(0 AS BIGINT) AS g FROM b
UNION SELECT x.source, x.node, x.g FROM (SELECT o.source, e.r AS node, min(o.g + e.wt) AS g FROM d o JOIN pe e ON e.p = o.node WHERE NOT e.pinched OR e.p = o.source GROUP BY 1, 2) x
LEFT JOIN recurring.d r ON r.source = x.source AND r.node = x.node WHERE r.g IS NULL OR x.g < r.g)
SELECT qid, d.g AS cost FROM b LEFT JOIN d ON d.source = b.source AND d.node = b.target""")
def point_search(spark, sf_dir):
    """Costs between lattice points; points where obstacles touch are left only by a start."""
    w = shapes.grid_width(spark, sf_dir) + 1
    if w * w <= kernels.MAX_CELLS:
        return _run(spark, sf_dir, kernels.point_astar).withColumn("cost", F.col("cost").cast("bigint"))
    steps = grid.point_steps(_cells(spark, sf_dir))
    edges = cut(steps.select(geo.cell_id(F.col("x"), F.col("y"), w).alias("src"), geo.cell_id(F.col("x2"), F.col("y2"), w).alias("dst"), "wt", "pinched"))
    ends = _queries(spark, sf_dir).select("qid", geo.cell_id(F.col("sx"), F.col("sy"), w).alias("source"), geo.cell_id(F.col("tx"), F.col("ty"), w).alias("target"))
    found = search.point_to_point(edges, ends, keep=~F.col("pinched") | (F.col("src") == F.col("qid")))
    return found.select("qid", "cost")


@query(f"""WITH {GRID}, {_ENDS} SELECT qid, row_number() OVER (ORDER BY length, qid) AS place, length FROM (SELECT qid, least(abs(sx - tx), abs(sy - ty)) * 141421 + (greatest(abs(sx - tx), abs(sy - ty)) - least(abs(sx - tx), abs(sy - ty))) * 100000 AS length FROM q)""")
def queries_by_distance(spark, sf_dir):
    return workload.by_distance(_queries(spark, sf_dir)).select("qid", "place", "length")


@query(f"WITH {GRID}, {_ENDS} SELECT qid FROM q ORDER BY md5('5:' || qid), qid LIMIT 7")
def sampled_queries(spark, sf_dir):
    return workload.sampled(_queries(spark, sf_dir), 7, 5).select("qid")


@query(f"""WITH {GRID}, fr AS (SELECT x, y, row_number() OVER (ORDER BY y, x) AS place, count(*) OVER () AS n FROM f), n AS (SELECT max(n) AS n FROM fr)
SELECT i AS qid, a.x AS sx, a.y AS sy, b.x AS tx, b.y AS ty FROM range(0, 300) r(i), n JOIN fr a ON a.place = i % n.n + 1 JOIN fr b ON b.place = n.n - (i + i // n.n) % n.n""")
def generated_queries(spark, sf_dir):
    """Cells from the start of the map paired with cells from its end."""
    return workload.generated(_cells(spark, sf_dir), count=300)


@query("SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation WHERE n_nationkey % 4 <> 1")
def workload_complement(spark, sf_dir):
    """Nodes that another worker's share leaves."""
    nodes = shapes.nation_nodes(spark, sf_dir).select(F.col("id").alias("node"))
    return workload.complement(nodes, workload.slice_of(nodes, 4, 1))


@query(f"WITH {GRID} SELECT x, y, ok AND substr(md5('9:' || x || ':' || y), 1, 4) < '4000' AS rough FROM c")
def rough_terrain(spark, sf_dir):
    """A quarter of the free cells turned rough."""
    return grid.roughened(_cells(spark, sf_dir), 9).select("x", "y", "rough")


def _mask_sql() -> str:
    """Successor directions of every free cell for each direction of arrival, by the rules for each."""
    side = {"N": "EW", "S": "EW", "E": "NS", "W": "NS"}
    back = {"N": "S", "S": "N", "E": "W", "W": "E"}
    bit = {"N": 1, "S": 2, "E": 4, "W": 8, "NE": 16, "NW": 32, "SE": 64, "SW": 128}
    pair = lambda a, b: a + b if a in "NS" else b + a
    at = lambda n: _free(f"a.x + {_D[n][0]}", f"a.y + {_D[n][1]}")
    legal = " + ".join(f"CASE WHEN {' AND '.join(at(m) for m in (n, *(n if len(n) == 2 else '')))} THEN {bit[n]} ELSE 0 END" for n in _D)
    rows = []
    for n in _D:
        want = [str(bit[n] | bit[n[0]] | bit[n[1]])] if len(n) == 2 else [str(bit[n])] + [f"CASE WHEN {at(s)} AND NOT {at(pair(s, back[n]))} THEN {bit[s] | bit[pair(s, n)]} ELSE 0 END" for s in side[n]]
        rows.append(f"SELECT a.x, a.y, '{n}' AS arrived, CAST(({' | '.join(want)}) & ({legal}) AS INT) AS mask FROM f a")
    return " UNION ALL ".join(rows)


@query(f"WITH {GRID} {_mask_sql()}")
def successor_directions(spark, sf_dir):
    """Natural and forced directions of every cell and arrival."""
    around = grid.neighbourhood(_cells(spark, sf_dir)).where("ok").select("x", "y", "free", F.explode(F.array(*map(F.lit, _D))).alias("arrived"))
    return around.select("x", "y", "arrived", jumps.successor_mask(F.col("free"), F.col("arrived")).cast("int").alias("mask"))


@query()
def any_angle_search(spark, sf_dir):
    """Shortest paths between lattice points by intervals over the free runs of rows."""
    area = intervals.rectangle_mesh(intervals.row_runs(kernels.grid_array(_cells(spark, sf_dir))))
    return _run(spark, sf_dir, intervals.grid_interval_search, area).withColumn("cost", F.round("cost", 6))


@query()
def mesh_search(spark, sf_dir):
    """The same over a mesh of large rectangles, between centres of cells."""
    area = intervals.rectangle_mesh(mesh.best_rectangles(kernels.grid_array(_cells(spark, sf_dir)) > 0))
    return _run(spark, sf_dir, lambda m, a, b: intervals.interval_search(m, (a[0] + 0.5, a[1] + 0.5), (b[0] + 0.5, b[1] + 0.5), shift=True), area).withColumn("cost", F.round("cost", 6))


@query(_costs(_steps(_D), "d.g AS forward, d.g") + _VALID)
def corner_hierarchy_search(spark, sf_dir):
    """The corner graph contracted; searched from both ends and forward."""
    graph, queries = jumps.corner_graph(_cells(spark, sf_dir), shapes.grid_width(spark, sf_dir)), _valid_queries(spark, sf_dir)
    contracted = jumps.corner_hierarchy(graph)
    if graph.width**2 <= kernels.MAX_CELLS and contracted[0].count() <= kernels.MAX_CELLS:
        domain = jumps.CornerHierarchy(jumps.walks_of(_cells(spark, sf_dir), graph.table), *contracted, graph.width)
        both, forward = (kernels.run_queries(queries, domain, functools.partial(jumps.corner_hierarchy_search, forward=way), paths=False) for way in (False, True))
        both, forward = (found.select("qid", F.col("cost").cast("bigint").alias(c)) for found, c in ((both, "cost"), (forward, "forward")))
        return both.join(forward, "qid")
    return workload.once(queries, lambda queries: jumps.corner_hierarchy_costs(graph, contracted, queries))


def _any_angle_sql(shift: float) -> str:
    """Shortest lengths over the visibility graph: ends, and lattice points with one blocked cell.

    A segment is free if it meets no blocked cell's inside, no point within it
    where obstacles touch, and, along a grid line, no unit that is blocked on both sides.
    """
    return f"""WITH RECURSIVE {GRID}, {_ENDS}, h AS (SELECT max(y) + 1 AS h FROM c),
blk AS (SELECT i AS cx, j AS cy FROM w, h, range(0, w.w) r(i), range(0, h.h) s(j) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.x = i AND f.y = j)),
pm AS (SELECT x + dx AS x, y + dy AS y, sum(CASE WHEN ok THEN bit ELSE 0 END) AS mask FROM c, (VALUES (0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8)) v(dx, dy, bit) GROUP BY 1, 2),
fl AS (SELECT i AS x, j AS y FROM w, h, range(0, w.w) r(i), range(0, h.h + 1) s(j) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.x = i AND f.y IN (j - 1, j))),
up AS (SELECT i AS x, j AS y FROM w, h, range(0, w.w + 1) r(i), range(0, h.h) s(j) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.y = j AND f.x IN (i - 1, i))),
v AS (SELECT q.* FROM q WHERE {"EXISTS (SELECT 1 FROM pm WHERE pm.x = sx AND pm.y = sy AND mask > 0) AND EXISTS (SELECT 1 FROM pm WHERE pm.x = tx AND pm.y = ty AND mask > 0)" if not shift else f"{_free('q.sx', 'q.sy')} AND {_free('q.tx', 'q.ty')}"}),
nd AS (SELECT row_number() OVER (ORDER BY x, y) AS id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM pm WHERE bit_count(CAST(mask AS BIGINT)) = 3
UNION ALL SELECT -2 * qid - 1, sx + {shift}, sy + {shift} FROM v UNION ALL SELECT -2 * qid - 2, tx + {shift}, ty + {shift} FROM v),
pr AS (SELECT a.id AS src, b.id AS dst, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM nd a JOIN nd b ON a.id <> b.id AND (a.id > 0 OR a.id % 2 <> 0) AND (b.id > 0 OR b.id % 2 = 0) AND (a.id > 0 OR b.id > 0 OR a.id - 1 = b.id)),
pf AS (SELECT j AS cy, i AS x, count(blk.cx) AS n FROM w, h, range(0, w.w + 1) r(i), range(0, h.h) s(j) LEFT JOIN blk ON blk.cy = j AND blk.cx < i GROUP BY 1, 2),
rw AS (SELECT src, dst, ax, ay, bx, by_, unnest(range(CAST(floor(least(ay, by_)) AS BIGINT), greatest(CAST(ceil(greatest(ay, by_)) AS BIGINT), CAST(floor(least(ay, by_)) AS BIGINT) + CASE WHEN ay = by_ AND ay <> floor(ay) THEN 1 ELSE 0 END))) AS cy FROM pr),
xr AS (SELECT src, dst, cy, CASE WHEN ay = by_ THEN ax ELSE ax + (greatest(cy, least(ay, by_)) - ay) * (bx - ax) / (by_ - ay) END AS x1, CASE WHEN ay = by_ THEN bx ELSE ax + (least(cy + 1, greatest(ay, by_)) - ay) * (bx - ax) / (by_ - ay) END AS x2 FROM rw),
lh AS (SELECT src, dst, cy, CAST(floor(round(least(x1, x2), 9)) AS BIGINT) AS lo, CAST(ceil(round(greatest(x1, x2), 9)) AS BIGINT) AS hi FROM xr),
bad AS (SELECT DISTINCT src, dst FROM lh JOIN pf a ON a.cy = lh.cy AND a.x = lo JOIN pf b ON b.cy = lh.cy AND b.x = hi WHERE lo < hi AND b.n > a.n
UNION SELECT src, dst FROM pr JOIN pm ON mask IN (6, 9) AND (bx - ax) * (pm.y - ay) = (by_ - ay) * (pm.x - ax) AND pm.x BETWEEN least(ax, bx) AND greatest(ax, bx) AND pm.y BETWEEN least(ay, by_) AND greatest(ay, by_)
AND NOT (pm.x = ax AND pm.y = ay) AND NOT (pm.x = bx AND pm.y = by_)
UNION SELECT src, dst FROM pr JOIN fl ON ay = by_ AND fl.y = ay AND fl.x >= least(ax, bx) AND fl.x + 1 <= greatest(ax, bx)
UNION SELECT src, dst FROM pr JOIN up ON ax = bx AND up.x = ax AND up.y >= least(ay, by_) AND up.y + 1 <= greatest(ay, by_)),
e AS (SELECT src, dst, sqrt((ax - bx) ^ 2 + (ay - by_) ^ 2) AS wt FROM pr WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.src = pr.src AND bad.dst = pr.dst)),
d(source, node, g) USING KEY (source, node) AS (SELECT -2 * qid - 1 AS source, -2 * qid - 1 AS node, CAST(0 AS DOUBLE) AS g FROM v
UNION SELECT x.source, x.node, x.g FROM (SELECT o.source, e.dst AS node, min(o.g + e.wt) AS g FROM d o JOIN e ON e.src = o.node WHERE e.dst > 0 OR e.dst = o.source - 1 GROUP BY 1, 2) x
LEFT JOIN recurring.d r ON r.source = x.source AND r.node = x.node WHERE r.g IS NULL OR x.g < r.g - 1e-9)
SELECT q.qid, round(d.g, 6) AS cost FROM q LEFT JOIN d ON d.source = -2 * q.qid - 1 AND d.node = -2 * q.qid - 2"""


ORACLES["any_angle_search"], ORACLES["mesh_search"] = _any_angle_sql(0), _any_angle_sql(0.5)
