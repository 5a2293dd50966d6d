"""Round trips: tables written in each format to the shared folder and read back, against SQL over the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import geometry as geo
from pathloom.functions import scalars
from pathloom.operators import analytics, grid, labels, mesh, timed
from pathloom.plans import grid_queries, shapes
from pathloom.plans.graph_queries import _FIRSTS, _firsts, _parts
from pathloom.plans.lineage import cut, shared_dir
from pathloom.plans.shapes import GRID, NATIONS, TRADE
from pathloom.sources import meshes, readers, tables, writers

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


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {TRADE} SELECT src, dst, wt FROM t")
def io_dimacs_graph(spark, sf_dir):
    path = _path(spark, "gr")
    writers.dimacs_graph(shapes.trade(spark, sf_dir), path)
    return readers.dimacs_graph(spark, path)


@query(f"WITH {TRADE} SELECT src, dst, wt FROM t WHERE src >= 5 AND src < 9")
def io_dimacs_slice(spark, sf_dir):
    path = _path(spark, "gr")
    writers.dimacs_graph(shapes.trade(spark, sf_dir), path, low=5, high=9)
    return readers.dimacs_graph(spark, path)


@query(f"WITH {NATIONS} SELECT id, x, y FROM nn")
def io_dimacs_coordinates(spark, sf_dir):
    path = _path(spark, "co")
    writers.dimacs_coordinates(shapes.nation_nodes(spark, sf_dir), path)
    return readers.dimacs_coordinates(spark, path)


@query("SELECT o_orderkey AS source, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS target FROM orders")
def io_dimacs_queries(spark, sf_dir):
    """Lines with and without a target, between comments."""
    path = _path(spark, "p2p")
    o = shapes.table(spark, sf_dir, "orders")
    line = F.concat_ws(" ", F.lit("q"), "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")))
    o.select(F.explode(F.array(F.lit("c a comment"), line)).alias("value")).write.text(path)
    return readers.dimacs_queries(spark, path)


_SCENARIO = "CAST(o_orderkey % 9 AS INT) AS bucket, 'm' || o_custkey % 4 AS map, CAST(64 AS INT) AS width, CAST(32 AS INT) AS height, CAST(o_orderkey % 64 AS DOUBLE) AS sx, CAST(o_orderkey % 32 AS DOUBLE) AS sy, CAST(o_custkey % 64 AS DOUBLE) AS tx, o_custkey % 32 + 0.5 AS ty"


@query(f"SELECT {_SCENARIO}, o_orderkey % 1000 + 0.25 AS dist, CAST(2 AS INT) AS precision FROM orders")
def io_scenario(spark, sf_dir):
    path = _path(spark, "scen")
    o = shapes.table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = o.select(
        (k % 9).alias("bucket"), F.concat(F.lit("m"), (c % 4).cast("string")).alias("map"), F.lit(64).alias("width"), F.lit(32).alias("height"),
        (k % 64).alias("sx"), (k % 32).alias("sy"), (c % 64).alias("tx"), (c % 32 + 0.5).alias("ty"), (k % 1000 + 0.25).cast("double").alias("dist"),
    )
    writers.scenario(rows, path)
    return readers.scenario(spark, path)


@query("SELECT 'm' || o_custkey % 4 AS map, CAST(o_orderkey % 64 AS INT) AS sx, CAST(o_orderkey % 32 AS INT) AS sy, CAST(o_custkey % 64 AS INT) AS tx, CAST(o_custkey % 32 AS INT) AS ty, o_orderkey % 1000 + 0.5 AS dist FROM orders")
def io_scenario_legacy(spark, sf_dir):
    path = _path(spark, "scen3")
    o = shapes.table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    line = F.concat_ws(" ", F.concat(F.lit("m"), (c % 4).cast("string")), *(x.cast("string") for x in (k % 64, k % 32, c % 64, c % 32)), (k % 1000 + 0.5).cast("double").cast("string"))
    o.select(F.explode(F.array(F.lit("version 3"), line, F.lit("too short"))).alias("value")).write.text(path)
    return readers.scenario_legacy(spark, path)


@query("SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(row_number() OVER (ORDER BY (n_nationkey * 7) % 25) - 1 AS BIGINT) AS rank FROM nation")
def io_node_order(spark, sf_dir):
    path = _path(spark, "order")
    ranks = shapes.nation_nodes(spark, sf_dir).select(F.col("id").alias("node"), ((F.col("id") * 7) % 25).alias("rank"))
    writers.node_order(ranks, path)
    return readers.node_order(spark, path)


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS node, CAST(n_regionkey AS BIGINT) AS part FROM nation")
def io_partition(spark, sf_dir):
    """Parts, one a line, numbered from 1."""
    path = _path(spark, "part")
    nodes = shapes.nation_nodes(spark, sf_dir)
    lines = nodes.select("id", F.col("part").cast("string").alias("value")).unionByName(nodes.limit(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit("# parts").alias("value")))
    lines.orderBy("id").select("value").write.text(path)
    return readers.partition_labels(spark, path, first=1)


_RESULT = "SELECT event_id AS id, event_type AS owner, user_id AS expanded, value AS pcost FROM events"


@query(_RESULT)
def io_results_tsv(spark, sf_dir):
    path = _path(spark, "tsv")
    e = shapes.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("owner"), F.col("user_id").alias("expanded"), F.col("value").alias("pcost"))
    writers.results(e, path)
    return readers.results(spark, [path], "id bigint, owner string, expanded bigint, pcost double").drop("file")


@query(_RESULT)
def io_results_semicolon(spark, sf_dir):
    path = _path(spark, "csv")
    e = shapes.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("owner"), F.col("user_id").alias("expanded"), F.col("value").alias("pcost"))
    writers.results(e, path, sep=";")
    return readers.results(spark, [path], "id bigint, owner string, expanded bigint, pcost double", sep=";").drop("file")


@query("SELECT event_type AS owner, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def io_results_by_owner(spark, sf_dir):
    """One folder for each owner."""
    path = _path(spark, "owners")
    e = shapes.table(spark, sf_dir, "events").select(F.col("event_type").alias("owner"), F.col("event_id").alias("id"), "value")
    writers.results_by_owner(e, path)
    return spark.read.csv(path, schema="id bigint, value double, owner string", header=True).groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {NATIONS} SELECT 'path ' || part || '; ' || string_agg('(' || x || ', ' || y || ')', ' ' ORDER BY x, y) AS value FROM nn GROUP BY part")
def io_paths(spark, sf_dir):
    path = _path(spark, "paths")
    rows = shapes.nation_nodes(spark, sf_dir).groupBy(F.col("part").alias("qid")).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("path"))
    writers.paths(rows, path)
    return spark.read.text(path)


@query("""WITH p AS (SELECT DISTINCT least(s_nationkey, s_suppkey % 20) + 1 AS a, greatest(s_nationkey, s_suppkey % 20) + 1 AS b FROM supplier WHERE s_nationkey <> s_suppkey % 20),
n AS (SELECT max(b) AS n FROM p), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p)
SELECT CAST(0 AS BIGINT) AS node, (SELECT n FROM n) || ' ' || count(*) AS value FROM p UNION ALL
SELECT i AS node, coalesce((SELECT string_agg(CAST(b AS VARCHAR), ' ' ORDER BY b) FROM e WHERE a = i), '') AS value FROM n, range(1, n.n + 1) r(i)""")
def io_metis(spark, sf_dir):
    """Neighbour lists, with empty lines for nodes without neighbours."""
    path = _path(spark, "metis")
    s = shapes.table(spark, sf_dir, "supplier")
    a, b = F.col("s_nationkey").cast("bigint"), F.col("s_suppkey") % 20
    writers.metis(s.where(a != b).select((F.least(a, b) + 1).alias("a"), (F.greatest(a, b) + 1).alias("b")).distinct(), path)
    return readers.neighbour_lists(spark, path)


@query(f"""WITH {GRID}, m AS (SELECT max(y) AS h FROM c) SELECT x, y, tile FROM c
UNION ALL SELECT i AS x, m.h AS y, '@' AS tile FROM w, m, range(0, w.w) r(i) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.x = i AND c.y = m.h)""")
def io_grid_map(spark, sf_dir):
    """The grid as a map file, its last row filled up with blocked tiles."""
    path = _path(spark, "map")
    cells = shapes.grid(spark, sf_dir).select("x", "y", "tile")
    top = cells.agg(F.max("y").alias("h"), (F.max("x") + 1).alias("w"))
    rows = cells.groupBy("y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "tile"))), lambda c: c["tile"]), "").alias("value"))
    rows = rows.join(top).select("y", F.rpad("value", F.col("w").cast("int"), F.lit("@")).alias("value"))
    head = top.select(F.lit(-1).cast("bigint").alias("y"), F.concat(F.lit("type octile\nheight "), (F.col("h") + 1).cast("string"), F.lit("\nwidth "), F.col("w").cast("string"), F.lit("\nmap")).alias("value"))
    head.unionByName(rows).orderBy("y").coalesce(1).select("value").write.text(path)
    return readers.grid_map(spark, path).select("x", "y", "tile")


@query(f"WITH {GRID} SELECT x, y, CASE WHEN tile = '.' THEN 0 ELSE 4294967295 END AS v_lab, CAST(5 AS DOUBLE) AS e_sum FROM c")
def grid_labels(spark, sf_dir):
    """Vertex and edge labels of tiles."""
    out = readers.labelled_cells(shapes.grid(spark, sf_dir).select("x", "y", "tile"))
    return out.select("x", "y", "v_lab", F.aggregate("e_lab", F.lit(0.0), lambda s, x: s + x).alias("e_sum"))


_UNIT = f"""WITH {GRID}, n AS (SELECT x, y FROM f), pt AS (SELECT DISTINCT x + dx AS x, y + dy AS y FROM f, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) v(dx, dy))
SELECT (SELECT count(*) FROM pt) AS vertices, count(*) AS polygons, CAST(4 * count(*) AS BIGINT) AS sides,
CAST(sum({" + ".join(f"CASE WHEN EXISTS (SELECT 1 FROM f b WHERE b.x = n.x + {dx} AND b.y = n.y + {dy}) THEN 1 ELSE 0 END" for dx, dy in ((0, -1), (1, 0), (0, 1), (-1, 0)))}) AS BIGINT) AS open_sides,
CAST(sum(2 * x + 1 + 2 * y + 1) AS DOUBLE) * 2 AS places FROM n"""


def _mesh_figures(vertices: DataFrame, polygons: DataFrame) -> DataFrame:
    side = polygons.select("file", "pid", F.explode(F.arrays_zip("vertices", "neighbours")).alias("s")).select("file", "pid", "s.vertices", "s.neighbours")
    placed = side.join(vertices.select("file", F.col("vid").alias("vertices"), "x", "y"), ["file", "vertices"])
    figures = placed.agg(F.countDistinct("pid").alias("polygons"), F.count(F.lit(1)).alias("sides"), F.count_if(F.col("neighbours") >= 0).alias("open_sides"), F.sum(F.col("x") + F.col("y")).alias("places"))
    return vertices.agg(F.count(F.lit(1)).alias("vertices")).join(figures)


@query(_UNIT)
def io_mesh(spark, sf_dir):
    """The unit mesh as a mesh file: its vertices, polygons, sides and the sum of their places."""
    path = _path(spark, "mesh")
    rings = mesh.unit_mesh(shapes.grid(spark, sf_dir).select("x", "y", "ok"), shapes.grid_width(spark, sf_dir))
    meshes.write_mesh(*map(cut, meshes.tables_of(rings)), path)
    return _mesh_figures(*meshes.read_mesh(spark, path))


@query(_UNIT)
def io_mesh_packed(spark, sf_dir):
    """The same in three-byte integers."""
    path = _path(spark, "packed")
    rings = mesh.unit_mesh(shapes.grid(spark, sf_dir).select("x", "y", "ok"), shapes.grid_width(spark, sf_dir))
    meshes.write_mesh(*map(cut, meshes.tables_of(rings)), path, packed=True)
    return _mesh_figures(*meshes.read_mesh(spark, path, packed=True))


@query(f"WITH {GRID} SELECT count(*) AS polygons, CAST(sum(2 * x + 1 + 2 * y + 1) AS DOUBLE) * 2 AS places, CAST(2 * count(*) AS DOUBLE) AS double_areas FROM f")
def io_polymap(spark, sf_dir):
    """Unit squares as a polygon map, and their areas."""
    path = _path(spark, "poly")
    meshes.write_polymap(mesh.unit_mesh(shapes.grid(spark, sf_dir).select("x", "y", "ok"), shapes.grid_width(spark, sf_dir)).select("pid", "ring"), path)
    places = F.aggregate("ring", F.lit(0.0), lambda s, p: s + p["x"] + p["y"])
    return meshes.read_polymap(spark, path).agg(F.count(F.lit(1)).alias("polygons"), F.sum(places).alias("places"), F.sum(geo.double_area(F.col("ring"))).alias("double_areas"))


@query(f"WITH {_FIRSTS} SELECT source, first, bit_or(CAST(1 AS BIGINT) << CAST(part AS INT)) AS flags, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM fe JOIN nn ON id = node GROUP BY ALL")
def io_labels(spark, sf_dir):
    """Flags and boxes, saved and loaded."""
    path, firsts = _path(spark, "labels"), _firsts(spark, sf_dir)
    both = labels.arc_flags(firsts, _parts(spark, sf_dir)).join(labels.boxes(firsts, shapes.nation_nodes(spark, sf_dir).select("id", "x", "y")), ["source", "first"])
    tables.save(both, path, "flags_and_boxes")
    return tables.load(spark, path, "flags_and_boxes").withColumn("flags", F.get("flags", F.lit(0)))


@query(f"WITH {TRADE}, {NATIONS} SELECT t.src, t.dst, t.wt, a.x AS x1, b.x AS x2 FROM t JOIN nn a ON a.id = src JOIN nn b ON b.id = dst")
def io_graph(spark, sf_dir):
    path = _path(spark, "graph")
    tables.save(shapes.nation_nodes(spark, sf_dir), path, "nodes")
    tables.save(shapes.trade(spark, sf_dir), path, "edges")
    nodes = tables.load(spark, path, "nodes")
    a, b = (nodes.select(F.col("id").alias(e), F.col("x").alias(n)) for e, n in (("src", "x1"), ("dst", "x2")))
    return tables.load(spark, path, "edges").join(a, "src").join(b, "dst").select("src", "dst", "wt", "x1", "x2")


@query(f"{grid_queries.ORACLES['diagonal_jumps']} UNION ALL SELECT x, y, dir, steps, dead_end FROM j")
def io_jump_table(spark, sf_dir):
    path = _path(spark, "jumps")
    cells = shapes.grid(spark, sf_dir).select("x", "y", "ok")
    tables.save(grid.jump_table(cells).unionByName(grid.diagonal_jumps(cells)), path, "jumps")
    return tables.load(spark, path, "jumps")


@query("SELECT user_id AS unit, event_id AS t, CAST(event_id % 50 AS DOUBLE) AS x, value AS y FROM events")
def io_history(spark, sf_dir):
    """Moves of units as JSON lines."""
    path = _path(spark, "history")
    e = shapes.table(spark, sf_dir, "events")
    tables.save_history(e.select(F.col("user_id").alias("unit"), F.col("event_id").alias("t"), (F.col("event_id") % 50).cast("double").alias("x"), F.col("value").alias("y")), path)
    return tables.load_history(spark, path)


_TRACE = "SELECT o_custkey AS qid, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'expanding' ELSE 'generating' END AS type, o_orderkey % 97 AS node, CAST(o_orderkey % 31 AS DOUBLE) AS g FROM orders"


@query(_TRACE)
def io_trace(spark, sf_dir):
    path = _path(spark, "trace")
    o = shapes.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    events = o.select(F.col("o_custkey").alias("qid"), k.alias("seq"), F.when(k % 2 == 0, "expanding").otherwise("generating").alias("type"), (k % 97).alias("node"), (k % 31).cast("double").alias("g"))
    writers.trace(events, path)
    return spark.read.schema("qid bigint, seq bigint, type string, node bigint, g double").json(path)


@query("SELECT l_orderkey, l_linenumber, l_suppkey AS cell, least(abs(l_partkey - 40), 9) AS clipped, (l_suppkey | (1 << CAST(l_linenumber AS INT))) AS with_bit, (l_suppkey >> CAST(l_linenumber AS INT)) & 1 = 1 AS has_bit, CAST(trunc((l_discount - 0.05) * 100000) AS BIGINT) AS weight, 'run' || l_linenumber AS name FROM lineitem")
def scalar_functions(spark, sf_dir):
    """Clipping, bit vectors, fixed-point weights and names of runs."""
    line = shapes.table(spark, sf_dir, "lineitem")
    bit = F.col("l_linenumber")
    return line.select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("cell"), F.least(F.abs(F.col("l_partkey") - 40), F.lit(9)).alias("clipped"), scalars.bit_set(F.col("l_suppkey"), bit).alias("with_bit"),
        scalars.bit_get(F.col("l_suppkey"), bit).alias("has_bit"), geo.fixed_weight(F.col("l_discount") - 0.05).alias("weight"), scalars.base_name(F.concat(F.lit("/a/b\t/run\t"), bit.cast("string"))).alias("name"),
    )


@query("""WITH v AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey AS a0, l_suppkey AS a1, l_suppkey AS b0, l_partkey // 2 AS b1 FROM lineitem)
SELECT k, i, a0 | b0 AS m0, a1 | b1 AS m1, a0 = b0 AND a1 = b1 AS same, CAST(bit_count(a0 | b0) + bit_count(a1 | b1) AS BIGINT) AS n FROM v""")
def bit_vectors(spark, sf_dir):
    """Unions of bit vectors of two words, whether both sides are equal, and how many bits the union has."""
    line = shapes.table(spark, sf_dir, "lineitem")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    a, b = F.array(part, supp), F.array(supp, F.floor(part / 2).cast("bigint"))
    both = line.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), scalars.bits_merged(a, b).alias("m"), scalars.bits_equal(a, b).alias("same"))
    return both.select("k", "i", F.get("m", F.lit(0)).alias("m0"), F.get("m", F.lit(1)).alias("m1"), "same", scalars.bits_count(F.col("m")).alias("n"))


@query(f"""WITH {NATIONS}, p AS (SELECT a.id AS a, b.id AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM nn a, nn b WHERE a.y < 2 AND b.y > 2)
SELECT a, b, ax <= bx + 1 AND bx <= ax + 1 AND ay <= by_ + 1 AND by_ <= ay + 2 AS meet,
round(CASE WHEN ax + (2 - ay) * (bx - ax) / CAST(by_ - ay AS DOUBLE) < 1 THEN sqrt((ax - 1) ^ 2 + (ay - 2) ^ 2) + sqrt((bx - 1) ^ 2 + (by_ - 2) ^ 2)
 WHEN ax + (2 - ay) * (bx - ax) / CAST(by_ - ay AS DOUBLE) > 3 THEN sqrt((ax - 3) ^ 2 + (ay - 2) ^ 2) + sqrt((bx - 3) ^ 2 + (by_ - 2) ^ 2) ELSE sqrt((ax - bx) ^ 2 + (ay - by_) ^ 2) END, 6) AS over,
CASE WHEN ax = bx THEN NULL ELSE round((2 - ax) / CAST(bx - ax AS DOUBLE), 6) + 0.0 END AS along, CAST(abs(ax * by_ - ay * bx) AS DOUBLE) AS area FROM p""")
def interval_geometry(spark, sf_dir):
    """Boxes that meet, lengths over an interval in both forms, where lines cross, and areas of triangles at the origin."""
    n = shapes.nation_nodes(spark, sf_dir)
    a = n.where("y < 2").select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = n.where("y > 2").select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    p = a.crossJoin(b)  # a stated set of points
    ax, ay, bx, by = (F.col(c).cast("double") for c in ("ax", "ay", "bx", "by"))
    one, two, three = F.lit(1.0), F.lit(2.0), F.lit(3.0)
    flat = geo.interval_bound(ax, ay, one, three, two, bx, by)
    free = geo.segment_bound(ax, ay, one, two, three, two, bx, by)
    ring = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(ax.alias("x"), ay.alias("y")), F.struct(bx.alias("x"), by.alias("y")))
    mirrored = geo.segment_bound(ax, ay, one, two, three, two, bx, 4 - by)
    agreed = F.when((F.abs(flat - free) < 1e-9) & (F.abs(free - mirrored) < 1e-9), F.round(flat, 6))
    return p.select(
        "a", "b", geo.boxes_meet(ax, ay, ax + 1, ay + 2, bx, by, bx + 1, by + 1).alias("meet"), agreed.alias("over"),
        F.round(geo.line_parameter(ax, ay, bx, by, two, F.lit(-9.0), two, F.lit(9.0)), 6).alias("along"), F.round(F.abs(geo.double_area(ring)), 6).alias("area"),
    )


@query("SELECT event_type, count(*) AS n, round(median(value), 6) AS middle FROM events GROUP BY 1")
def group_function(spark, sf_dir):
    """Any function of one group's rows."""
    import pandas as pd

    def middle(rows):
        return pd.DataFrame({"event_type": [rows["event_type"].iloc[0]], "n": [len(rows)], "middle": [round(float(rows["value"].median()), 6)]})

    return analytics.group_apply(shapes.table(spark, sf_dir, "events").select("event_type", "value"), "event_type", middle, "event_type string, n bigint, middle double")


_TIMED = f"""WITH {TRADE}, k AS (SELECT DISTINCT o_custkey % 25 AS cell, CAST(o_orderkey % 211 AS INT) AS t FROM orders), l0 AS (SELECT CAST(0 AS BIGINT) AS cell, 0 AS t, CAST(0 AS BIGINT) AS g), """ + ", ".join(
    f"l{i} AS (SELECT cell, {i} AS t, min(g) AS g FROM (SELECT dst AS cell, g + wt AS g FROM l{i - 1} JOIN t ON src = cell UNION ALL SELECT cell, g + 1 FROM l{i - 1}) s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.cell = s.cell AND k.t = {i}) GROUP BY cell)" for i in range(1, 5)
) + " , a AS (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(5)) + ") SELECT CAST(n_nationkey AS BIGINT) AS cell, (SELECT min_by(t, g * 10 + t) FROM a WHERE a.cell = n_nationkey) AS t, (SELECT min(g) FROM a WHERE a.cell = n_nationkey) AS g FROM nation"


@query(_TIMED)
def timed_labelled_arrival(spark, sf_dir):
    """Cheapest, then earliest arrivals over weighted moves past reserved cells; entries are added to a constraint table and taken from reservations."""
    o = shapes.table(spark, sf_dir, "orders")
    held = o.select((F.col("o_custkey") % 25).alias("cell"), (F.col("o_orderkey") % 211).cast("int").alias("t")).distinct()
    none = held.limit(0).select("cell", "t", F.lit(True).alias("v"), F.lit(0).alias("e_mask"))
    constraints = cut(timed.with_constraints(none, held.select("cell", "t", F.lit(True).alias("v"), F.lit(0).alias("e_mask"))))
    edges = cut(shapes.trade(spark, sf_dir))
    layered = timed.layers(edges, 0, 4, constraints, weighted=True)
    return timed.arrival(layered, shapes.nation_nodes(spark, sf_dir).select(F.col("id").alias("cell")))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id AS qid, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def trace_sessions(spark, sf_dir):
    """Sessions of events, as the trace stream forms them."""
    from pathloom.streaming import trace

    e = shapes.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("qid"))
    out = trace.sessions(e, gap="6 hours")
    # Wall-clock microseconds, whatever the session's time zone.
    us = lambda c: F.unix_micros(F.to_utc_timestamp(F.from_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone()), "UTC"))
    return out.select("qid", us("start").alias("start_us"), us("end").alias("end_us"), "n")


@query(grid_queries.ORACLES["grid_graph"])
def io_grid_to_dimacs(spark, sf_dir):
    """The grid as a graph file."""
    path = _path(spark, "grid-gr")
    writers.dimacs_graph(grid.to_graph(shapes.grid(spark, sf_dir).select("x", "y", "ok"), shapes.grid_width(spark, sf_dir)), path)
    return readers.dimacs_graph(spark, path)


@query(f"""WITH {_FIRSTS}, l AS (SELECT source, first, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM fe JOIN nn ON id = node GROUP BY ALL)
SELECT CASE WHEN (first * 7) % 25 > (source * 7) % 25 THEN source ELSE first END AS node, CASE WHEN (first * 7) % 25 > (source * 7) % 25 THEN first ELSE source END AS other, (first * 7) % 25 > (source * 7) % 25 AS climbs, x1, y1, x2, y2 FROM l""")
def split_labels(spark, sf_dir):
    """Labels of climbing edges at their tail, those of falling ones at their head."""
    ranks = shapes.nation_nodes(spark, sf_dir).select(F.col("id").alias("node"), ((F.col("id") * 7) % 25).alias("rank"))
    boxes = labels.boxes(_firsts(spark, sf_dir), shapes.nation_nodes(spark, sf_dir).select("id", "x", "y")).withColumnsRenamed({"source": "src", "first": "dst"})
    up, down = labels.split_directions(boxes, ranks)
    named = lambda df, climbs: df.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(climbs).alias("climbs"), "x1", "y1", "x2", "y2")
    return named(up, True).unionByName(named(down, False))
