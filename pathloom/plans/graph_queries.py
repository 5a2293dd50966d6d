"""Queries over graphs derived from the star schema, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import graph, hierarchy, labels, search, timed
from pathloom.plans import shapes
from pathloom.plans.lineage import cut
from pathloom.plans.shapes import NATIONS, ROAD, TRADE, rounds

#: Relaxation rounds that the oracles unroll; more than the test graphs need.
K = 12

#: Cost between the cheapest open row and the dearest that is expanded with it, on the road graph.
DELTA = 2

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


def _nation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("bigint")
    return shapes.table(spark, sf_dir, "nation").select(n.alias("qid"), n.alias("node"))


def _nation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("bigint")
    return shapes.table(spark, sf_dir, "nation").select(n.alias("qid"), n.alias("source"), (F.lit(shapes.SUPPLIERS) + (n * 7) % 10).alias("target"))


def _least_node(edges: search.Network) -> DataFrame:
    return edges.edges.agg(F.min("src").alias("node")).select(F.lit(0).cast("bigint").alias("qid"), "node")


_SOURCES = "SELECT CAST(n_nationkey AS BIGINT) AS qid, CAST(n_nationkey AS BIGINT) AS node, CAST(0 AS BIGINT) AS g FROM nation"


@query(f"WITH {ROAD}, {rounds('e', 'SELECT CAST(0 AS BIGINT) AS qid, min(src) AS node, CAST(0 AS BIGINT) AS g FROM e', K)} SELECT node, g FROM r{K}")
def sssp_road(spark, sf_dir):
    """Single-source shortest paths from the smallest node."""
    edges = search.Network.of(shapes.road(spark, sf_dir))
    return search.relax(edges, _least_node(edges), preds=False).select("node", "g")


@query(f"WITH {ROAD}, {rounds('e', 'SELECT CAST(0 AS BIGINT) AS qid, min(src) AS node, CAST(0 AS BIGINT) AS g FROM e', 2)} SELECT node, g FROM r2")
def sssp_road_two_edges(spark, sf_dir):
    edges = search.Network.of(shapes.road(spark, sf_dir))
    return search.relax(edges, _least_node(edges), max_rounds=2, preds=False).select("node", "g")


@query(f"WITH {ROAD}, {rounds('e', 'SELECT CAST(0 AS BIGINT) AS qid, min(src) AS node, CAST(0 AS BIGINT) AS g FROM e', K)} SELECT node, g FROM r{K} WHERE g <= 6")
def sssp_road_cutoff(spark, sf_dir):
    """Search bounded by cost."""
    edges = search.Network.of(shapes.road(spark, sf_dir))
    return search.relax(edges, _least_node(edges), cutoff=6, preds=False).select("node", "g")


@query(f"""WITH {ROAD}, {rounds('e', _SOURCES, K)}, q AS (SELECT CAST(n_nationkey AS BIGINT) AS qid, CAST(n_nationkey AS BIGINT) AS source, {shapes.SUPPLIERS} + CAST(n_nationkey AS BIGINT) * 7 % 10 AS target FROM nation)
SELECT q.qid, source, target, g AS cost FROM q LEFT JOIN r{K} r ON r.qid = source AND r.node = target""")
def p2p_road(spark, sf_dir):
    """Point-to-point costs of a query table; equal sources share a tree."""
    return search.point_to_point(search.Network.of(shapes.road(spark, sf_dir)), _nation_queries(spark, sf_dir), delta=DELTA)


@query(ORACLES["p2p_road"])
def p2p_road_bidirectional(spark, sf_dir):
    """Two trees joined where they meet, grown until no cheaper path is left."""
    edges = search.Network.of(shapes.road(spark, sf_dir))
    return search.meet_in_middle(edges, graph.reverse(edges.edges), _nation_queries(spark, sf_dir))


_SETTLED = 200
_BOUNDED = f"""WITH {ROAD}, {rounds('e', _SOURCES, K)},
f AS (SELECT qid, node, g FROM r{K} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY g, node) <= {_SETTLED})
SELECT qid, node, min(g) AS g, bool_or(x) AS expanded FROM (SELECT qid, node, g, true AS x FROM f UNION ALL SELECT f.qid, e.dst, f.g + e.wt, false FROM f JOIN e ON e.src = f.node) GROUP BY qid, node"""


@query(_BOUNDED)
def bounded_search(spark, sf_dir):
    """Searches of all nations that end after a number of expansions, in steps of one cost range each."""
    return search.bounded(search.Network.of(shapes.road(spark, sf_dir)), _nation_sources(spark, sf_dir), _SETTLED, delta=DELTA)


_WORK = ", ".join(f"w{i} AS (SELECT b.qid, b.node, b.g, a.g IS NULL AS fresh FROM r{i} b LEFT JOIN r{i - 1} a USING (qid, node) WHERE a.g IS NULL OR b.g < a.g)" for i in range(1, K + 1))
_COUNTED = f"""WITH {TRADE}, {rounds('t', _SOURCES, K)}, w0 AS (SELECT qid, node, g, true AS fresh FROM r0), {_WORK}, d AS (SELECT src AS node, count(*) AS degree FROM t GROUP BY 1),
x AS ({" UNION ALL ".join(f"SELECT {i} AS round, qid, node, g, fresh FROM w{i}" for i in range(K + 1))})"""


def _trade_trace(spark: SparkSession, sf_dir: str) -> tuple[search.Network, list]:
    net, trace = search.Network.of(shapes.trade(spark, sf_dir)), []
    search.relax(net, _nation_sources(spark, sf_dir), trace=trace, preds=False)
    return net, trace


@query(f"""{_COUNTED} SELECT qid, count(*) AS expanded, CAST(sum(coalesce(degree, 0)) AS BIGINT) AS generated,
count(*) FILTER (fresh AND round > 0) AS inserted, count(*) FILTER (NOT fresh) AS updated FROM x LEFT JOIN d USING (node) GROUP BY qid""")
def search_counters(spark, sf_dir):
    """What a search from every nation expands, generates, inserts and updates."""
    return search.counters(*_trade_trace(spark, sf_dir))


@query(f"""{_COUNTED} SELECT qid, round, 'expanding' AS kind, node, g FROM x UNION ALL SELECT qid, round - 1, CASE WHEN fresh THEN 'inserting' ELSE 'updating' END, node, g FROM x WHERE round > 0""")
def search_trace(spark, sf_dir):
    """The same searches as a table of events."""
    return search.events(_trade_trace(spark, sf_dir)[1]).select("qid", "round", "kind", "node", "g")


_TREE = f"""{TRADE}, {rounds('t', _SOURCES, K)},
p AS (SELECT r.qid, r.node, min(t.src) AS pred FROM r{K} r JOIN t ON t.dst = r.node JOIN r{K} a ON a.qid = r.qid AND a.node = t.src WHERE a.g + t.wt = r.g AND r.node <> r.qid GROUP BY ALL)"""


@query(f"WITH {_TREE} SELECT r.qid, r.node, r.g, p.pred FROM r{K} r LEFT JOIN p USING (qid, node)")
def trees_trade(spark, sf_dir):
    """All shortest-path trees of the nation graph with the smallest predecessors."""
    return search.relax(cut(shapes.trade(spark, sf_dir)), _nation_sources(spark, sf_dir))


@query(f"""WITH RECURSIVE {_TREE}, walk AS (SELECT qid, node AS target, node AS here, CAST(node AS VARCHAR) AS path FROM r{K}
UNION ALL SELECT walk.qid, target, p.pred, p.pred || '-' || path FROM walk JOIN p ON p.qid = walk.qid AND p.node = walk.here)
SELECT qid, target, path FROM walk WHERE here = qid""")
def paths_trade(spark, sf_dir):
    """Paths followed through predecessors."""
    trees = search.relax(cut(shapes.trade(spark, sf_dir)), _nation_sources(spark, sf_dir))
    paths = search.extract_paths(trees, trees.select("qid", F.col("node").alias("target")))
    return paths.select("qid", "target", F.array_join(F.transform("path", lambda n: n.cast("string")), "-").alias("path"))


@query(f"WITH {TRADE}, {rounds('t', 'SELECT CAST(0 AS BIGINT) AS qid, CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS g', K)} SELECT node, CASE WHEN g <= 5 THEN 5.0 WHEN g <= 10 THEN 10.0 ELSE 20.0 END AS bound FROM r{K} WHERE g <= 20")
def deepening_trade(spark, sf_dir):
    """Growing cost bounds from one node."""
    return search.deepening(cut(shapes.trade(spark, sf_dir)), 0, [5.0, 10.0, 20.0])


@query(f"WITH {ROAD} SELECT node, sum(o) AS out_degree, sum(i) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node")
def degrees_road(spark, sf_dir):
    return graph.degrees(shapes.road(spark, sf_dir))


@query(f"SELECT l_partkey AS src, {shapes.SUPPLIERS} + l_suppkey AS dst, min(CAST(l_extendedprice AS BIGINT)) AS wt FROM lineitem GROUP BY 1, 2")
def parallel_edges(spark, sf_dir):
    """Parallel edges collapse to the least weight."""
    lines = shapes.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + shapes.SUPPLIERS).alias("dst"), F.floor("l_extendedprice").cast("bigint").alias("wt"))
    return graph.collapse(lines)


ORACLES["parallel_edges"] = ORACLES["parallel_edges"].replace("CAST(l_extendedprice AS BIGINT)", "CAST(floor(l_extendedprice) AS BIGINT)")


@query(f"WITH {TRADE} SELECT dst AS src, src AS dst, wt FROM t")
def reverse_trade(spark, sf_dir):
    return graph.reverse(shapes.trade(spark, sf_dir))


@query(f"WITH {ROAD} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e WHERE src <> dst")
def undirected_road(spark, sf_dir):
    return graph.undirected(shapes.road(spark, sf_dir), shapes.tasks(shapes.table(spark, sf_dir, "lineitem")))


@query(f"""WITH {ROAD}, u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e),
d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM u UNION ALL SELECT dst FROM u) GROUP BY node),
k AS (SELECT node, row_number() OVER (ORDER BY degree DESC, node) AS place, count(*) OVER () AS n FROM d),
m AS (SELECT node, row_number() OVER (ORDER BY node) AS number FROM k WHERE place <= floor(n * 0.2))
SELECT a.number AS a, b.number AS b FROM u JOIN m a ON a.node = src JOIN m b ON b.node = dst""")
def core_road(spark, sf_dir):
    """The undirected graph of the best connected fifth, densely numbered."""
    return graph.core(cut(shapes.road(spark, sf_dir)), 20)


@query(f"WITH {TRADE}, {NATIONS} SELECT src, dst, greatest(wt, CAST(ceil(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS BIGINT)) AS wt FROM t JOIN nn a ON a.id = src JOIN nn b ON b.id = dst")
def euclidean_weights(spark, sf_dir):
    """Weights raised to the Euclidean length."""
    return graph.raise_to_distance(shapes.trade(spark, sf_dir), shapes.nation_nodes(spark, sf_dir))


@query(f"WITH {ROAD} SELECT src, dst, wt FROM e WHERE dst NOT IN (SELECT {shapes.SUPPLIERS} + s_suppkey FROM supplier WHERE s_acctbal < 0)")
def node_flags(spark, sf_dir):
    """Edges into flagged nodes are pruned."""
    flagged = shapes.table(spark, sf_dir, "supplier").where("s_acctbal < 0").select((F.col("s_suppkey") + shapes.SUPPLIERS).alias("node"))
    return graph.without_nodes(shapes.road(spark, sf_dir), flagged)


@query(f"WITH {TRADE} SELECT src, dst, wt FROM t WHERE src % 3 <> 0 AND dst % 3 <> 0")
def corridor_edges(spark, sf_dir):
    """Edges inside a corridor of nodes."""
    allowed = shapes.nation_nodes(spark, sf_dir).where("id % 3 <> 0").select(F.col("id").alias("node"))
    return graph.corridor(shapes.trade(spark, sf_dir), allowed)


@query(f"WITH {TRADE}, u AS (SELECT src, dst, wt FROM t WHERE src % 3 <> 1 AND dst % 3 <> 1), {rounds('u', 'SELECT CAST(0 AS BIGINT) AS qid, CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS g', K)} SELECT node, g FROM r{K}")
def corridor_search(spark, sf_dir):
    """Search inside a corridor."""
    allowed = shapes.nation_nodes(spark, sf_dir).where("id % 3 <> 1").select(F.col("id").alias("node"))
    return search.single_source(cut(graph.corridor(shapes.trade(spark, sf_dir), allowed)), 0).select("node", "g")


@query(f"WITH {TRADE}, {NATIONS} SELECT src, dst, wt FROM t JOIN nn a ON a.id = src JOIN nn b ON b.id = dst WHERE a.part <> b.part")
def cluster_edges(spark, sf_dir):
    """Edges that leave their cluster."""
    clusters = shapes.nation_nodes(spark, sf_dir).select(F.col("id").alias("node"), F.col("part").alias("cluster"))
    return graph.across_clusters(shapes.trade(spark, sf_dir), clusters)


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.nation_nodes(spark, sf_dir).select(F.col("id").alias("node"), ((F.col("id") * 7) % 25).alias("rank"))


@query(f"WITH {TRADE} SELECT src, dst, wt, (dst * 7) % 25 > (src * 7) % 25 AS up FROM t")
def hierarchy_direction(spark, sf_dir):
    """Edges with their direction in a contraction order."""
    return graph.with_direction(shapes.trade(spark, sf_dir), _ranks(spark, sf_dir))


@query(f"""WITH RECURSIVE {TRADE}, dn AS (SELECT src, dst FROM t WHERE (dst * 7) % 25 < (src * 7) % 25),
c AS (SELECT CAST(n_nationkey AS BIGINT) AS top, CAST(n_nationkey AS BIGINT) AS node FROM nation UNION SELECT c.top, dn.dst FROM c JOIN dn ON dn.src = c.node) SELECT top, node FROM c""")
def down_closure_trade(spark, sf_dir):
    """Nodes reachable along falling ranks."""
    return graph.down_closure(cut(shapes.trade(spark, sf_dir)), _ranks(spark, sf_dir))


@query(f"""WITH {TRADE}, s AS (SELECT src, dst FROM t), h0 AS (SELECT CAST(n_nationkey AS BIGINT) AS start, CAST(n_nationkey AS BIGINT) AS node, 0 AS hops FROM nation),
h1 AS (SELECT start, dst AS node, 1 AS hops FROM h0 JOIN s ON src = node), h2 AS (SELECT start, dst AS node, 2 AS hops FROM h1 JOIN s ON src = node)
SELECT start, node, min(hops) AS hops FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL""")
def closure_two_hops(spark, sf_dir):
    """Nodes within two steps."""
    starts = shapes.nation_nodes(spark, sf_dir).select(F.col("id").alias("start"))
    return graph.closure(cut(shapes.trade(spark, sf_dir)), starts, 2)


@query("SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation, (SELECT count(*) AS n FROM nation) WHERE (n_nationkey * 7) % 25 < n * 0.4")
def contracted_share(spark, sf_dir):
    """Nodes below a percentage of the contraction order."""
    ranks = _ranks(spark, sf_dir)
    return ranks.where(F.col("rank") < F.lit(ranks.count() * 0.4)).select("node")


_FIRSTS = f"""{TRADE}, {NATIONS}, {rounds('t', _SOURCES, K)},
fe AS (SELECT t.src AS source, d.node, t.dst AS first FROM t JOIN r{K} a ON a.qid = t.dst JOIN r{K} d ON d.qid = t.src AND d.node = a.node WHERE t.wt + a.g = d.g AND d.node <> t.src)"""


def _firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(shapes.trade(spark, sf_dir))
    return cut(search.optimal_first_edges(edges, search.relax(edges, _nation_sources(spark, sf_dir))))


@query(f"WITH {_FIRSTS} SELECT source, node, string_agg(CAST(first AS VARCHAR), ',' ORDER BY first) AS moves FROM fe GROUP BY ALL")
def first_move_sets(spark, sf_dir):
    """All optimal first edges of every pair, ties kept."""
    sets = labels.move_sets(_firsts(spark, sf_dir))
    return sets.select("source", "node", F.array_join(F.transform("moves", lambda m: m.cast("string")), ",").alias("moves"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.nation_nodes(spark, sf_dir).select(F.col("id").alias("node"), "part")


@query(f"WITH {_FIRSTS} SELECT source, first, bit_or(CAST(1 AS BIGINT) << CAST(part AS INT)) AS flags FROM fe JOIN nn ON id = node GROUP BY ALL")
def arc_flags(spark, sf_dir):
    return labels.arc_flags(_firsts(spark, sf_dir), _parts(spark, sf_dir)).withColumn("flags", F.get("flags", F.lit(0)))


@query(f"WITH {_FIRSTS} SELECT source, first, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM fe JOIN nn ON id = node GROUP BY ALL")
def bounding_boxes(spark, sf_dir):
    return labels.boxes(_firsts(spark, sf_dir), shapes.nation_nodes(spark, sf_dir).select("id", "x", "y"))


@query(f"""WITH {_FIRSTS} SELECT source, first, bit_or(CAST(1 AS BIGINT) << CAST(part AS INT)) AS flags, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2,
min(node) AS id1, max(node) AS id2, min((node * 7) % 25) AS rank1, max((node * 7) % 25) AS rank2 FROM fe JOIN nn ON id = node GROUP BY ALL""")
def closure_labels(spark, sf_dir):
    """Flags, box, id and rank ranges of first edges in one aggregation."""
    told = labels.closure_labels(_firsts(spark, sf_dir), shapes.nation_nodes(spark, sf_dir).select("id", "x", "y"), _parts(spark, sf_dir), _ranks(spark, sf_dir))
    return told.withColumn("flags", F.get("flags", F.lit(0)))


@query(f"""WITH {_FIRSTS}, l AS (SELECT source, first, bit_or(CAST(1 AS BIGINT) << CAST(part AS INT)) AS flags, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM fe JOIN nn ON id = node GROUP BY ALL)
SELECT source, first, g.id AS target, (flags >> CAST(g.part AS INT)) & 1 = 1 AS by_flag, g.x BETWEEN x1 AND x2 AND g.y BETWEEN y1 AND y2 AS by_box FROM l, nn g""")
def label_filters(spark, sf_dir):
    """Which edges labels keep for each of the stated targets."""
    firsts, nodes = _firsts(spark, sf_dir), shapes.nation_nodes(spark, sf_dir)
    both = labels.arc_flags(firsts, _parts(spark, sf_dir)).join(labels.boxes(firsts, nodes.select("id", "x", "y")), ["source", "first"])
    targets = nodes.select(F.col("id").alias("target"), "x", "y", "part")
    met = both.crossJoin(targets)  # a stated query set, one row per target
    return met.select("source", "first", "target", labels.keeps_part(F.col("flags"), F.col("part")).alias("by_flag"), labels.keeps_box(F.col("x"), F.col("y")).alias("by_box"))


@query(f"""WITH {_FIRSTS}, q AS (SELECT CAST(n_nationkey AS BIGINT) AS qid, CAST(n_nationkey AS BIGINT) AS source, (CAST(n_nationkey AS BIGINT) * 11 + 3) % 25 AS target FROM nation)
SELECT q.qid, r.g AS cost FROM q LEFT JOIN r{K} r ON r.qid = source AND r.node = target""")
def first_move_paths(spark, sf_dir):
    """Costs of paths followed through run-length compressed first moves."""
    edges = cut(shapes.trade(spark, sf_dir))
    order = shapes.nation_nodes(spark, sf_dir).select(F.col("id").alias("node"), F.col("id").alias("place"))
    runs = cut(labels.compress_rows(labels.move_sets(_firsts(spark, sf_dir)), order))
    n = F.col("id")
    queries = shapes.nation_nodes(spark, sf_dir).select(n.alias("qid"), n.alias("source"), ((n * 11 + 3) % 25).alias("target"))
    paths = labels.follow_moves(runs, order, queries)
    hops = paths.select("qid", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")), "path").select("qid", F.col("col").alias("src"), F.expr("path[pos + 1]").alias("dst"))
    cost = hops.join(edges, ["src", "dst"]).groupBy("qid").agg(F.sum("wt").alias("cost"))
    return paths.select("qid", (F.size("path") == 1).alias("here")).join(cost, "qid", "left").select("qid", F.when(F.col("here"), F.lit(0)).otherwise(F.col("cost")).cast("bigint").alias("cost"))


def _pairs_sql(columns: str) -> str:
    """All pairs of nations with their least cost over the trade graph, under the names of ``columns``."""
    return f"""WITH {TRADE}, {rounds('t', _SOURCES, K)}, q AS (SELECT a.n_nationkey * 25 + b.n_nationkey AS qid, CAST(a.n_nationkey AS BIGINT) AS source, CAST(b.n_nationkey AS BIGINT) AS target FROM nation a, nation b)
SELECT CAST(q.qid AS BIGINT) AS qid, source, target, {columns} FROM q LEFT JOIN r{K} r ON r.qid = source AND r.node = target"""


def _pair_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = shapes.nation_nodes(spark, sf_dir)
    met = n.select(F.col("id").alias("source")).crossJoin(n.select(F.col("id").alias("target")))  # the stated queries
    return met.select((F.col("source") * 25 + F.col("target")).alias("qid"), "source", "target")


def _beside(first: DataFrame, **others: DataFrame) -> DataFrame:
    for name, other in others.items():
        first = first.join(other.select("qid", F.col("cost").alias(name)), "qid")
    return first


@query(_pairs_sql("g AS cost, g AS forward, g AS stalled"))
def hierarchy_search(spark, sf_dir):
    """Contraction in independent batches, queried from both ends, forward, and from both ends with stalls."""
    edges = cut(shapes.trade(spark, sf_dir))
    ranks = hierarchy.independent_ranks(edges)
    built, queries = cut(hierarchy.contract(edges, ranks)), cut(_pair_queries(spark, sf_dir))
    return _beside(hierarchy.query_costs(built, ranks, queries), forward=hierarchy.forward_costs(built, ranks, queries), stalled=hierarchy.query_costs(built, ranks, queries, stall=True))


@query(_pairs_sql("g AS cost"))
def lazy_hierarchy(spark, sf_dir):
    """Contraction by priority; a tenth of the nodes stay as the core."""
    built, ranks = hierarchy.lazy_contract(cut(shapes.trade(spark, sf_dir)), percent=90)
    return hierarchy.query_costs(cut(built), ranks, cut(_pair_queries(spark, sf_dir)))


def _labelled_hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges with labels of optimal ways, ranks, queries, what filters know of their targets) over a fixed order."""
    edges, ranks, nodes, parts = cut(shapes.trade(spark, sf_dir)), cut(_ranks(spark, sf_dir)), shapes.nation_nodes(spark, sf_dir), _parts(spark, sf_dir)
    built = cut(hierarchy.contract(edges, ranks))
    labelled = labels.edge_labels(built, search.relax(edges, _nation_sources(spark, sf_dir)), nodes, parts)
    queries = cut(_pair_queries(spark, sf_dir))
    return cut(labelled), ranks, queries, cut(labels.targets_of(queries, nodes, parts, ranks))


@query(_pairs_sql("g AS cost, g AS boxes, g AS both"))
def hierarchy_labels(spark, sf_dir):
    """Search from both ends whose edges must carry the target's part, its place, or both."""
    built, ranks, queries, targets = _labelled_hierarchy(spark, sf_dir)
    part, box = labels.keeps_part(F.col("flags"), F.col("tpart")), labels.keeps_box(F.col("tx"), F.col("ty"))
    run = lambda keep: hierarchy.query_costs(built, ranks, queries, stall=True, context=targets, keep=keep)
    return _beside(run(part), boxes=run(box), both=run(labels.stacked([part, box])))


@query(_pairs_sql("g AS cost, g AS boxes, g AS both"))
def forward_labels(spark, sf_dir):
    """Forward search whose falling edges must carry the target's part, its place, or both, and rank no lower than it."""
    built, ranks, queries, targets = _labelled_hierarchy(spark, sf_dir)
    part, box = labels.keeps_part(F.col("flags"), F.col("tpart")), labels.keeps_box(F.col("tx"), F.col("ty"))
    high = F.col("dst_rank") >= F.col("trank")
    run = lambda keep: hierarchy.forward_costs(built, ranks, queries, context=targets, keep=keep & high)
    return _beside(run(part), boxes=run(box), both=run(labels.stacked([part, box])))


@query(_pairs_sql("g AS cost, g AS ids"))
def forward_closure_labels(spark, sf_dir):
    """Forward search pruned by labels of what can be reached along ranks: all parts of the label, and id ranges alone."""
    edges, ranks, nodes, parts = cut(shapes.trade(spark, sf_dir)), cut(_ranks(spark, sf_dir)), shapes.nation_nodes(spark, sf_dir), _parts(spark, sf_dir)
    built, queries = cut(hierarchy.contract(edges, ranks)), cut(_pair_queries(spark, sf_dir))
    labelled = cut(built.join(labels.down_labels(built, nodes, parts, ranks), ["src", "dst"]))
    targets = cut(labels.targets_of(queries, nodes, parts, ranks))
    run = lambda keep: hierarchy.forward_costs(labelled, ranks, queries, context=targets, keep=keep)
    return _beside(run(labels.keeps_closure()), ids=run(labels.keeps_closure(part=False, box=False, ranks=False)))


@query(_pairs_sql("g AS cost"))
def apex_search(spark, sf_dir):
    """Forward search again, with what its first run found to be the top of the path."""
    edges, ranks = cut(shapes.trade(spark, sf_dir)), cut(_ranks(spark, sf_dir))
    built, queries = cut(hierarchy.contract(edges, ranks)), cut(_pair_queries(spark, sf_dir))
    return hierarchy.apex_costs(built, ranks, queries, cut(hierarchy.apexes(built, ranks, queries)))


_STATED = "q AS (SELECT CAST(n_nationkey AS BIGINT) AS qid, CAST(n_nationkey AS BIGINT) AS source, (CAST(n_nationkey AS BIGINT) * 11 + 3) % 25 AS target FROM nation)"


def _stated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    return shapes.nation_nodes(spark, sf_dir).select(n.alias("qid"), n.alias("source"), ((n * 11 + 3) % 25).alias("target"))


@query(f"WITH {TRADE}, {rounds('t', _SOURCES, K)}, {_STATED} SELECT q.qid, g AS cost FROM q LEFT JOIN r{K} r ON r.qid = source AND r.node = target")
def unpacked_paths(spark, sf_dir):
    """What the original edges of paths found in a hierarchy cost together."""
    edges = cut(shapes.trade(spark, sf_dir))
    built, ranks = hierarchy.lazy_contract(edges, percent=20)
    queries = cut(_stated_queries(spark, sf_dir))
    steps = hierarchy.paths(cut(built), ranks, queries).join(edges, ["src", "dst"]).groupBy("qid").agg(F.sum("wt").alias("cost"))
    here = F.when(F.col("source") == F.col("target"), F.lit(0).cast("bigint"))
    return queries.join(steps, "qid", "left").select("qid", F.coalesce("cost", here).alias("cost"))


@query(ORACLES["unpacked_paths"])
def forward_first_moves(spark, sf_dir):
    """Forward search over a hierarchy that follows run-length compressed first moves of its states."""
    edges = cut(shapes.trade(spark, sf_dir))
    built, ranks = hierarchy.lazy_contract(edges, percent=20)
    built, ranks = cut(built), cut(ranks)
    order = shapes.nation_nodes(spark, sf_dir).select(F.col("id").alias("node"), F.col("id").alias("place"))
    runs = cut(labels.compress_rows(labels.move_sets(hierarchy.first_moves(built, ranks)), order))
    return hierarchy.first_move_costs(built, ranks, cut(_stated_queries(spark, sf_dir)), runs, order).select("qid", "cost")


_RAISED = f"{TRADE}, {NATIONS}, u AS (SELECT src, dst, greatest(wt, CAST(ceil(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS BIGINT)) AS wt FROM t JOIN nn a ON a.id = src JOIN nn b ON b.id = dst)"


@query(f"""WITH {_RAISED}, {rounds('u', _SOURCES, K)}, q AS (SELECT CAST(n_nationkey AS BIGINT) AS qid, CAST(n_nationkey AS BIGINT) AS source, (CAST(n_nationkey AS BIGINT) * 11 + 3) % 25 AS target FROM nation)
SELECT q.qid, source, target, g AS cost FROM q LEFT JOIN r{K} r ON r.qid = source AND r.node = target""")
def goal_directed_trade(spark, sf_dir):
    """Costs of single queries, their search cut off by straight-line distance."""
    nodes, n = shapes.nation_nodes(spark, sf_dir), F.col("id")
    edges = cut(graph.raise_to_distance(shapes.trade(spark, sf_dir), nodes))
    return search.goal_directed(edges, nodes, nodes.select(n.alias("qid"), n.alias("source"), ((n * 11 + 3) % 25).alias("target")))


@query(ORACLES["goal_directed_trade"])
def guided_hierarchy(spark, sf_dir):
    """The same by a search over a hierarchy from both ends with straight-line estimates."""
    nodes = shapes.nation_nodes(spark, sf_dir)
    built, ranks = hierarchy.lazy_contract(cut(graph.raise_to_distance(shapes.trade(spark, sf_dir), nodes)), percent=20)
    return hierarchy.guided_costs(cut(built), ranks, nodes, cut(_stated_queries(spark, sf_dir)))


@query(f"WITH {TRADE}, {rounds('t', _SOURCES, K)} SELECT node AS target, qid AS node, g FROM r{K}")
def target_distances(spark, sf_dir):
    """The exact rest to every nation, from a search against the edges."""
    n = F.col("n_nationkey").cast("bigint")
    return search.distances_to(cut(shapes.trade(spark, sf_dir)), shapes.table(spark, sf_dir, "nation").select(n.alias("target")))


@query(f"WITH {TRADE}, " + ", ".join(
    [f"l0 AS (SELECT CAST(0 AS BIGINT) AS cell, 0 AS t, CAST(0 AS BIGINT) AS g)"]
    + [f"l{i} AS (SELECT cell, {i} AS t, min(g) AS g FROM (SELECT dst AS cell, g + 1 AS g, CASE WHEN dst > src THEN 1 ELSE 2 END AS bit FROM l{i - 1} JOIN t ON src = cell UNION ALL SELECT cell, g + 1, 0 FROM l{i - 1}) s"
       f" WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.cell = s.cell AND k.t = {i} AND (k.v OR (k.e_mask & s.bit) <> 0)) GROUP BY cell)" for i in range(1, 5)]
).replace("l0 AS", "k AS (SELECT cell, t, bool_or(cell % 4 = 0) AS v, min(m) AS e_mask FROM (SELECT o_custkey % 25 AS cell, o_orderkey % 211 AS t, CAST(o_custkey % 3 AS INT) AS m FROM orders) GROUP BY ALL), l0 AS", 1) + " " + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(5)))
def timed_search(spark, sf_dir):
    """Layers of a time-expanded search under vertex and edge constraints."""
    orders = shapes.table(spark, sf_dir, "orders")
    rows = orders.select((F.col("o_custkey") % 25).alias("cell"), (F.col("o_orderkey") % 211).cast("int").alias("t"), (F.col("o_custkey") % 3).cast("int").alias("m"))
    constraints = rows.groupBy("cell", "t").agg(F.bool_or(F.col("cell") % 4 == 0).alias("v"), F.min("m").alias("e_mask"))
    edges = shapes.trade(spark, sf_dir).withColumn("bit", F.when(F.col("dst") > F.col("src"), 1).otherwise(2))
    return timed.layers(cut(edges), 0, 4, cut(constraints))


@query("SELECT DISTINCT o_custkey AS cell, CAST(o_orderkey % 16 AS INT) AS t FROM orders EXCEPT SELECT c_custkey AS cell, CAST(x AS INT) AS t FROM customer, range(0, 16) r(x) WHERE c_nationkey = 3")
def reservations(spark, sf_dir):
    """A reservation table, with some taken back."""
    orders, customers = shapes.table(spark, sf_dir, "orders"), shapes.table(spark, sf_dir, "customer")
    held = timed.reserve(orders.select(F.col("o_custkey").alias("cell"), (F.col("o_orderkey") % 16).cast("int").alias("t")).limit(0), orders.select(F.col("o_custkey").alias("cell"), (F.col("o_orderkey") % 16).cast("int").alias("t")))
    gone = customers.where("c_nationkey = 3").select(F.col("c_custkey").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("t"))
    return timed.unreserve(held, gone)


