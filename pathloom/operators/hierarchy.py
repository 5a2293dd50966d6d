"""Contraction hierarchies: contraction by rank or by priority, searches over them with labels and pruning, unpacking."""

from __future__ import annotations

import heapq
import operator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pathloom.operators.graph import collapse
from pathloom.operators.search import Network, State, extract_paths, relax
from pathloom.plans.lineage import cut

_EDGE = ("src", "dst", "wt", "via")


def _witnessed(candidates: DataFrame, rest: DataFrame, hops: int) -> DataFrame:
    """Candidates (src, dst, wt) without a path of at most ``hops`` edges in ``rest`` that is cheaper; ties keep the shortcut."""
    most = candidates.groupBy("src").agg(F.max("wt").alias("limit"))
    found = most.select("src", F.col("src").alias("at"), F.lit(0).cast("bigint").alias("g"), "limit")
    best = found
    for _ in range(hops):
        steps = found.join(rest.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("wt").alias("w")), "at")
        found = steps.select("src", F.col("to").alias("at"), (F.col("g") + F.col("w")).alias("g"), "limit").where("g < limit").groupBy("src", "at", "limit").agg(F.min("g").alias("g")).select("src", "at", "g", "limit")
        best = best.unionByName(found)
    best = best.groupBy("src", F.col("at").alias("dst")).agg(F.min("g").alias("g"))
    return candidates.join(best, ["src", "dst"], "left").where("g is null or g >= wt").select("src", "dst", "wt")


def _through(left: DataFrame, now: DataFrame) -> DataFrame:
    """(src, dst, wt, via): the cheapest two-edge paths over the nodes ``now`` (column node), via the smallest on ties."""
    into = left.join(now.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("a"), F.col("dst").alias("v"), F.col("wt").alias("w1"))
    outof = left.join(now.withColumnRenamed("node", "src"), "src").select(F.col("src").alias("v"), F.col("dst").alias("b"), F.col("wt").alias("w2"))
    paths = into.join(outof, "v").where("a <> b").groupBy("a", "b").agg(F.min(F.struct((F.col("w1") + F.col("w2")).alias("wt"), F.col("v").alias("via"))).alias("s"))
    return paths.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("s.wt").alias("wt"), F.col("s.via").alias("via"))


def _contracted(left: DataFrame, now: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """(edges of the nodes ``now``, the graph left without them, shortcuts included); both tables must be written ones."""
    ends = [now.withColumnRenamed("node", c) for c in ("src", "dst")]
    done = left.join(ends[0], "src", "left_semi").unionByName(left.join(ends[1], "dst", "left_semi")).select(*_EDGE)
    rest = left.join(ends[0], "src", "left_anti").join(ends[1], "dst", "left_anti").select(*_EDGE)
    candidates = cut(_through(left, now))
    needed = candidates.join(_witnessed(candidates.drop("via"), rest, hops).select("src", "dst"), ["src", "dst"], "left_semi").select(*_EDGE)
    both = rest.unionByName(needed).groupBy("src", "dst").agg(F.min(F.struct("wt", "via")).alias("s"))
    return done, cut(both.select("src", "dst", "s.wt", "s.via"))


def _scored(left: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, p): the shortcuts that a node's contraction needs, as far as single edges tell, less the edges it removes; hashes break ties."""
    into = left.join(nodes.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("a"), F.col("dst").alias("node"), F.col("wt").alias("w1"))
    outof = left.join(nodes.withColumnRenamed("node", "src"), "src").select(F.col("src").alias("node"), F.col("dst").alias("b"), F.col("wt").alias("w2"))
    direct = left.select(F.col("src").alias("a"), F.col("dst").alias("b"), "wt")
    needed = into.join(outof, "node").where("a <> b").join(direct, ["a", "b"], "left").where("wt is null or wt >= w1 + w2").groupBy("node").agg(F.count(F.lit(1)).alias("needed"))
    edges = into.select("node").unionByName(outof.select("node")).groupBy("node").agg(F.count(F.lit(1)).alias("edges"))
    p = F.struct((F.coalesce("needed", F.lit(0)) - F.coalesce("edges", F.lit(0))).alias("d"), F.xxhash64("node").alias("h"), F.col("node").alias("n"))
    return nodes.join(needed, "node", "left").join(edges, "node", "left").select("node", p.alias("p"))


def _started(edges: DataFrame) -> DataFrame:
    return collapse(edges).where("src <> dst").select("src", "dst", "wt", F.lit(None).cast("bigint").alias("via"))


def _finished(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("src", "dst").agg(F.min(F.struct("wt", "via")).alias("s")).select("src", "dst", "s.wt", "s.via")


def contract(edges: DataFrame, ranks: DataFrame, hops: int = 2) -> DataFrame:
    """edges and shortcuts (src, dst, wt, via) when nodes are contracted by rank.

    Nodes of equal rank must not be neighbours; they are contracted together,
    and witnesses avoid them all.  A witness that is missed only adds a
    shortcut, so ``hops`` changes the size, never a distance.
    """
    levels = [row["rank"] for row in ranks.select("rank").distinct().orderBy("rank").toLocalIterator()]
    left, parts = cut(_started(edges)), []
    for level in levels:
        done, left = _contracted(left, ranks.where(F.col("rank") == level).select("node"), hops)
        parts.append(cut(done))
    return _finished([*parts, left])


def lazy_contract(edges: DataFrame, hops: int = 2, percent: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """(edges and shortcuts, ranks (node, rank)) when the cheapest nodes go first.

    A node's priority is the number of shortcuts that its contraction needs
    less the edges it removes.  Priorities are kept in a table: each round
    contracts the nodes with the least (priority, hash) among their neighbours,
    of which no two are neighbours, and scores only the neighbours of those that
    went.  ``percent`` of the nodes are contracted at least; the others are the
    core, on one rank at the top, so that their edges count as climbing and as falling.
    """
    left = cut(_started(edges))
    nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    wanted = nodes.count() * percent / 100
    score, parts, order, rank, gone = cut(_scored(left, nodes)), [], None, 0, 0
    while gone < wanted:
        a, b = score.select(F.col("node").alias("src"), "p"), score.select(F.col("node").alias("dst"), F.col("p").alias("q"))
        met = left.select("src", "dst").join(a, "src").join(b, "dst").select(F.when(F.col("p") < F.col("q"), F.col("dst")).otherwise(F.col("src")).alias("node"))
        told = Observation()
        batch = cut(score.join(met.distinct(), "node", "left_anti").select("node", F.lit(rank).alias("rank")).observe(told, F.count(F.lit(1)).alias("n")))
        now = batch.select("node")
        done, left = _contracted(left, now, hops)
        parts.append(done)
        order = batch if order is None else order.unionByName(batch)
        gone, rank = gone + told.get["n"], rank + 1
        touched = done.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(now, "node", "left_anti")
        still = score.join(now, "node", "left_anti").join(touched, "node", "left_anti")
        score = cut(still.unionByName(_scored(left, cut(touched))))
    if order is None:
        return _finished([left]), nodes.withColumn("rank", F.lit(0))
    core = nodes.join(order, "node", "left_anti").select("node", F.lit(rank).alias("rank"))
    return _finished([*parts, left]), cut(order.unionByName(core))


def _tile_contracted(edges: list[tuple], border: set, most_left: float) -> tuple[list[tuple], list]:
    """(edges and shortcuts (src, dst, wt, via), nodes in their order) of one tile, cheapest nodes first; those of ``border`` stay."""
    out, into, via = {}, {}, {}
    for a, b, wt, by in edges:
        for n in (a, b):
            out.setdefault(n, {}), into.setdefault(n, {})
        out[a][b] = into[b][a] = wt
        via[a, b] = by

    def score(v: int) -> int:
        after, n = out[v], 0
        for a, w1 in into[v].items():
            known = out[a]
            for b, w2 in after.items():
                if a != b and known.get(b, w1 + w2) >= w1 + w2:
                    n += 1
        return n - len(into[v]) - len(after)

    # Multiplied hashes break ties without a preference for small ids.
    mixed = lambda v: v * 0x9E3779B1 & 0xFFFFFFFF
    now = {v: score(v) for v in out if v not in border}
    heap = [(p, mixed(v), v) for v, p in now.items()]
    heapq.heapify(heap)
    done, order, left = [], [], len(out) * most_left
    while heap and len(out) > left:
        p, _, v = heapq.heappop(heap)
        if now.get(v) != p:
            continue
        del now[v]
        before, after = into.pop(v), out.pop(v)
        order.append(v)
        for a, w1 in before.items():
            done.append((a, v, w1, via[a, v]))
            del out[a][v]
        for b, w2 in after.items():
            done.append((v, b, w2, via[v, b]))
            del into[b][v]
        for a, w1 in before.items():
            limit, near = w1 + max(after.values(), default=0), out[a]
            best = dict(near)
            for x, w in near.items():
                if w < limit:
                    for b, w2 in out[x].items():
                        if b in after and w + w2 < best.get(b, limit + 1):
                            best[b] = w + w2
            for b, w2 in after.items():
                if a != b and w1 + w2 < best.get(b, w1 + w2 + 1):
                    near[b] = into[b][a] = w1 + w2
                    via[a, b] = v
        for n in before.keys() | after.keys():
            if n in now:
                p = score(n)
                if p != now[n]:
                    now[n] = p
                    heapq.heappush(heap, (p, mixed(n), n))
    return done + [(a, b, wt, via[a, b]) for a, near in out.items() for b, wt in near.items()], order


def tile_contract(edges: DataFrame, width: int, percent: float = 80.0, tile: int = 64) -> tuple[DataFrame, DataFrame]:
    """What ``lazy_contract`` gives, for a graph of the cells of a grid: each task contracts the inside of square tiles.

    Corners with edges to other tiles stay; the next pass has tiles twice as
    wide, until ``percent`` of the nodes are gone.  A witness outside a tile is
    missed, which only adds a shortcut.  The others are the core, on one rank at the top.
    """
    left = cut(_started(edges))
    nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    total, parts, order, rank = nodes.count(), [], None, 0
    wanted, gone = total * percent / 100, 0
    while gone < wanted:
        t = tile
        at = lambda c: F.struct(F.floor(F.col(c) % width / t).alias("x"), F.floor(F.floor(F.col(c) / width) / t).alias("y"))  # noqa: B023, E731
        placed = left.withColumns({"a": at("src"), "b": at("dst")})
        across = cut(placed.where("a <> b").select(*_EDGE))
        # Every tile has its inner edges and, as (node, null), its nodes on borders.
        fixed = across.select(F.explode(F.array("src", "dst")).alias("src")).distinct().select(at("src").alias("a"), "src", *(F.lit(None).cast("bigint").alias(c) for c in ("dst", "wt", "via")))
        rows = placed.where("a = b").select("a", *_EDGE).unionByName(fixed).groupBy("a").agg(F.collect_list(F.struct(*_EDGE)).alias("rows"))
        most_left = 1 - percent / 100

        def run(batches):
            for batch in batches:
                for rows in map(operator.methodcaller("as_py"), batch.column("rows")):
                    inner = [(r["src"], r["dst"], r["wt"], r["via"]) for r in rows if r["dst"] is not None]
                    found, went = _tile_contracted(inner, {r["src"] for r in rows if r["dst"] is None}, most_left)
                    table = [*found, *((v, None, i, None) for i, v in enumerate(went))]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in table], pa.int64()) for i in range(4)], names=list(_EDGE))

        done = cut(rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, total // 5000), "a").mapInArrow(run, "src bigint, dst bigint, wt bigint, via bigint"))
        batch = cut(done.where("dst is null").select(F.col("src").alias("node"), (F.col("wt") + rank).cast("int").alias("rank")))
        order = batch if order is None else order.unionByName(batch)
        told = batch.agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("top")).first()
        gone, rank = gone + told["n"], rank if told["top"] is None else told["top"] + 1
        found = done.where("dst is not null")
        ends = [batch.select(F.col("node").alias(c)) for c in ("src", "dst")]
        parts.append(cut(found.join(ends[0], "src", "left_semi").unionByName(found.join(ends[1], "dst", "left_semi")).select(*_EDGE)))
        left = cut(across.unionByName(found.join(ends[0], "src", "left_anti").join(ends[1], "dst", "left_anti").select(*_EDGE)))
        tile *= 2
    if order is None:
        return _finished([left]), nodes.withColumn("rank", F.lit(0))
    core = nodes.join(order, "node", "left_anti").select("node", F.lit(rank).alias("rank"))
    return _finished([*parts, left]), cut(order.unionByName(core))


def independent_ranks(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, rank) in batches: each round takes the nodes that have the least (degree, hash) among their neighbours left.

    A batch holds no two neighbours, as ``contract`` needs, shortcuts counted:
    the neighbours of a node that goes become neighbours of each other.  Hashes
    break ties without a preference for small ids.
    """
    pairs = edges.select("src", "dst").where("src <> dst")
    pairs = cut(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    out = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(pairs.select(F.col("src").alias("node")), "node", "left_anti").select("node", F.lit(0).alias("rank"))
    for rank in range(max_rounds):
        own = pairs.groupBy("src").agg(F.struct(F.count(F.lit(1)).alias("d"), F.xxhash64("src").alias("h"), F.col("src").alias("n")).alias("p"))
        other = own.select(F.col("src").alias("dst"), F.col("p").alias("q"))
        least = pairs.join(own, "src").join(other, "dst").groupBy("src").agg(F.min("q").alias("q"), F.first("p").alias("p"))
        batch = cut(least.where("p < q").select(F.col("src").alias("node"), F.lit(rank).alias("rank")))
        out = out.unionByName(batch)
        gone = batch.select("node")
        touched = pairs.select(F.col("src").alias("node")).distinct()
        pairs_left = cut(pairs.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        fill = pairs.join(gone.withColumnRenamed("node", "src"), "src", "left_semi").select("src", F.col("dst").alias("a"))
        fill = fill.join(fill.withColumnRenamed("a", "b"), "src").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        pairs_left = cut(pairs_left.unionByName(fill).distinct())
        # Nodes whose neighbours have all gone come last.
        alone = touched.join(gone, "node", "left_anti").join(pairs_left.select(F.col("src").alias("node")), "node", "left_anti")
        out = cut(out.unionByName(alone.select("node", F.lit(rank + 1).alias("rank"))))
        pairs = pairs_left
        if pairs.isEmpty():
            return out
    raise ValueError("the graph was not contracted in max_rounds rounds")


def _ranked(hierarchy: DataFrame, ranks: DataFrame) -> DataFrame:
    """Edges with src_rank and dst_rank."""
    a = ranks.select(F.col("node").alias("src"), F.col("rank").alias("src_rank"))
    b = ranks.select(F.col("node").alias("dst"), F.col("rank").alias("dst_rank"))
    return cut(hierarchy.join(a, "src").join(b, "dst"))


def layouts(hierarchy: DataFrame, ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges that climb, edges that fall, turned round), with all their columns; edges within a core are in both."""
    wide = _ranked(hierarchy, ranks)
    rest = [c for c in hierarchy.columns if c not in ("src", "dst")]
    down = wide.where("dst_rank <= src_rank").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return wide.where("dst_rank >= src_rank").select("src", "dst", *rest), down


def stalled(against: DataFrame):
    """A hook that does not expand rows to which an edge from above is cheaper (stall on demand).

    ``against`` holds the edges that fall in the direction of the search (src
    above dst): a higher node that is reached already and leads down for less
    shows that the row is on no shortest path.
    """

    def hook(frontier: DataFrame, state: DataFrame) -> DataFrame:
        above = state.select("qid", F.col("node").alias("src"), F.col("g").alias("above"))
        cheaper = above.join(against.select("src", F.col("dst").alias("node"), "wt"), "src").groupBy("qid", "node").agg(F.min(F.col("above") + F.col("wt")).alias("other"))
        return frontier.join(cheaper, ["qid", "node"], "left").where("other is null or other >= g").drop("other")

    return hook


def query_costs(hierarchy: DataFrame, ranks: DataFrame, queries: DataFrame, stall: bool = False, context: DataFrame | None = None, keep: Column | None = None) -> DataFrame:
    """(qid, source, target, cost): two upward searches joined at the top.

    ``stall`` turns on stall-on-demand; ``keep`` with ``context`` (one row for
    each qid) tests the labels of edges, on both sides.  Without labels,
    queries with one source or target share a search.
    """
    up, down = layouts(hierarchy, ranks)
    own = context is not None
    name = (lambda c: F.col("qid")) if own else F.col
    fwd = relax(up, queries.select(name("source").alias("qid"), F.col("source").alias("node")), on_expand=stalled(_turned(down)) if stall else None, context=context, keep=keep, preds=False)
    bwd = relax(down, queries.select(name("target").alias("qid"), F.col("target").alias("node")), on_expand=stalled(_turned(up)) if stall else None, context=context, keep=keep, preds=False)
    fwd = fwd.select(F.col("qid").alias("qid" if own else "source"), "node", F.col("g").alias("gf"))
    bwd = bwd.select(F.col("qid").alias("qid" if own else "target"), "node", F.col("g").alias("gb"))
    met = fwd.join(bwd, ["qid", "node"]) if own else queries.join(fwd, "source").join(bwd, ["target", "node"])
    best = met.groupBy("qid").agg(F.min(F.col("gf") + F.col("gb")).alias("cost"))
    return queries.join(best, "qid", "left").select("qid", "source", "target", "cost")


def guided_costs(hierarchy: DataFrame, ranks: DataFrame, nodes: DataFrame, queries: DataFrame, trace: list | None = None) -> DataFrame:
    """(qid, source, target, cost) by two upward searches that know where they go; ``nodes`` has id, x, y.

    Weights must be no less than the distance between their ends.  A row costs
    at least what it has cost plus the straight line to the other end; rows that
    so cannot beat the best meeting cost of their query are not followed.  The
    search ends when neither side has rows left.  ``trace`` takes (rows expanded, rows that improved) of every round and side.
    """
    up, down = (Network.of(e.select("src", "dst", "wt")) for e in layouts(hierarchy, ranks))
    at = nodes.select(F.col("id").alias("node"), "x", "y")
    goal = lambda end: queries.select("qid", F.col(end).alias("node")).join(at, "node").select("qid", F.col("x").alias("gx"), F.col("y").alias("gy"))
    sides = [(State(queries.select("qid", F.col(a).alias("node")), False), net, cut(goal(b))) for a, b, net in (("source", "target", up), ("target", "source", down))]
    open_ = [state.parts[0] for state, _, _ in sides]
    going = [1, 1]
    while any(going):
        first, second = (state.best().select("qid", "node", F.col("g").alias(c)) for (state, _, _), c in zip(sides, ("gf", "gb"), strict=True))
        best = cut(first.join(second, ["qid", "node"]).groupBy("qid").agg(F.min(F.col("gf") + F.col("gb")).alias("cost")))
        for i, (state, net, ends) in enumerate(sides):
            if not going[i]:
                continue
            wide = open_[i].join(at, "node").join(ends, "qid").join(best, "qid", "left")
            left = F.sqrt(F.pow(F.col("x") - F.col("gx"), 2) + F.pow(F.col("y") - F.col("gy"), 2))
            # Rounding must not turn an estimate into more than there is.
            kept = wide.where(F.col("cost").isNull() | (F.col("g") + F.floor(left - 1e-9) < F.col("cost"))).select("qid", "node", "g", "pred")
            steps = net.steps(kept).select("qid", F.col("dst").alias("node"), (F.col("g") + F.col("wt")).alias("g"), F.col("src").alias("pred"))
            better, going[i] = state.improve(steps)
            open_[i] = better.where("go").select("qid", "node", "g", "pred")
            if trace is not None:
                trace.append((kept, better))
    return queries.join(best, "qid", "left").select("qid", "source", "target", "cost")


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "wt")


def upward_tree(hierarchy: DataFrame, ranks: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, g) of the search that only climbs, from each source (column source)."""
    up, _ = layouts(hierarchy, ranks)
    return relax(up, sources.select(F.col("source").alias("qid"), F.col("source").alias("node")), preds=False).select(F.col("qid").alias("source"), "node", "g")


def _state(node: Column, climbing: Column) -> Column:
    return node * 2 + F.when(climbing, 1).otherwise(0)


def two_phase_edges(hierarchy: DataFrame, ranks: DataFrame) -> DataFrame:
    """Edges over states (node, still climbing): upward ones while climbing only, downward ones at any time; with ``fall``, src_rank and dst_rank."""
    wide = _ranked(hierarchy, ranks)
    rest = [c for c in wide.columns if c not in ("src", "dst")]
    yes, no = F.lit(True), F.lit(False)
    climb = wide.where("dst_rank >= src_rank").select(_state(F.col("src"), yes).alias("src"), _state(F.col("dst"), yes).alias("dst"), *rest, no.alias("fall"))
    drop = wide.where("dst_rank <= src_rank").select(F.explode(F.array(yes, no)).alias("was"), "*")
    return climb.unionByName(drop.select(_state(F.col("src"), F.col("was")).alias("src"), _state(F.col("dst"), no).alias("dst"), *rest, yes.alias("fall")))


def _per_target(trees: DataFrame, key: str) -> DataFrame:
    return trees.select(F.col("qid").alias(key), F.floor(F.col("node") / 2).cast("bigint").alias("target"), "g").groupBy(key, "target").agg(F.min("g").alias("cost"))


def forward_costs(hierarchy: DataFrame, ranks: DataFrame, queries: DataFrame, context: DataFrame | None = None, keep: Column | None = None) -> DataFrame:
    """The same costs by one search over ``two_phase_edges``.

    ``keep`` tests falling edges against ``context`` (one row for each qid);
    climbing edges are not tested.
    """
    edges = two_phase_edges(hierarchy, ranks)
    key = "source" if context is None else "qid"
    trees = relax(edges, queries.select(F.col(key).alias("qid"), _state(F.col("source"), F.lit(True)).alias("node")), context=context, keep=None if keep is None else ~F.col("fall") | keep, preds=False)
    return queries.join(_per_target(trees, key), [key, "target"], "left").select("qid", "source", "target", "cost")


def apexes(hierarchy: DataFrame, ranks: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, apex): the highest node of a shortest path of the forward search; null where there is no path."""
    edges = two_phase_edges(hierarchy, ranks)
    trees = relax(edges, queries.select("qid", _state(F.col("source"), F.lit(True)).alias("node")))
    ends = trees.join(queries.select("qid", "target"), "qid").where(F.floor(F.col("node") / 2) == F.col("target"))
    end = ends.groupBy("qid").agg(F.min(F.struct("g", "node")).alias("s")).select("qid", F.col("s.node").alias("target"))
    steps = extract_paths(trees, end).select("qid", F.explode("path").alias("at")).select("qid", F.floor(F.col("at") / 2).cast("bigint").alias("node"))
    top = steps.join(ranks, "node").groupBy("qid").agg(F.max(F.struct("rank", "node")).alias("m"))
    return queries.select("qid").join(top, "qid", "left").select("qid", F.col("m.node").alias("apex"), F.col("m.rank").alias("apex_rank"))


def apex_costs(hierarchy: DataFrame, ranks: DataFrame, queries: DataFrame, tops: DataFrame) -> DataFrame:
    """(qid, source, target, cost) by the forward search that climbs no higher than the apex and turns only there."""
    edges = two_phase_edges(hierarchy, ranks)
    climbing = F.col("src") % 2 == 1
    keep = F.when(F.col("fall"), ~climbing | (F.floor(F.col("src") / 2) == F.col("apex"))).otherwise(F.col("dst_rank") <= F.col("apex_rank"))
    trees = relax(edges, queries.select("qid", _state(F.col("source"), F.lit(True)).alias("node")), context=tops.select("qid", "apex", "apex_rank"), keep=keep, preds=False)
    return queries.join(_per_target(trees, "qid"), ["qid", "target"], "left").select("qid", "source", "target", "cost")


def first_moves(hierarchy: DataFrame, ranks: DataFrame) -> DataFrame:
    """(source, node, first): all optimal first steps of the forward search from every state to every node; source and first are states.

    A label of all pairs, for states: a way that has begun to fall may not climb again, so both states of a node have moves of their own.
    """
    edges = cut(two_phase_edges(hierarchy, ranks).select("src", "dst", "wt"))
    states = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    trees = relax(edges, states.select(F.col("node").alias("qid"), "node"), preds=False)
    best = cut(trees.groupBy(F.col("qid").alias("source"), F.floor(F.col("node") / 2).cast("bigint").alias("node")).agg(F.min("g").alias("g")))
    rest = best.select(F.col("source").alias("first"), "node", F.col("g").alias("rest"))
    steps = edges.select(F.col("src").alias("source"), F.col("dst").alias("first"), "wt").join(rest, "first").join(best, ["source", "node"])
    return steps.where((F.col("wt") + F.col("rest") == F.col("g")) & (F.floor(F.col("source") / 2) != F.col("node"))).select("source", "node", "first")


def first_move_costs(hierarchy: DataFrame, ranks: DataFrame, queries: DataFrame, runs: DataFrame, order: DataFrame) -> DataFrame:
    """(qid, source, target, cost) by the forward search that takes one step from every state, the first move to the target.

    ``runs`` are the moves of ``first_moves`` as run-length rows over ``order``;
    a target without a way has no run and gives null.
    """
    from pathloom.operators.labels import follow_moves

    begun = queries.select("qid", _state(F.col("source"), F.lit(True)).alias("source"), "target")
    walks = cut(follow_moves(runs, order, begun, F.floor(F.col("at") / 2) == F.col("target")))
    hops = walks.select("qid", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("pos", "src"), "path").select("qid", "src", F.expr("path[pos + 1]").alias("dst"))
    sums = hops.join(two_phase_edges(hierarchy, ranks).select("src", "dst", "wt"), ["src", "dst"]).groupBy("qid").agg(F.sum("wt").alias("cost"))
    arrived = walks.where("path is not null").select("qid", F.lit(0).cast("bigint").alias("none")).join(sums, "qid", "left").select("qid", F.coalesce("cost", "none").alias("cost"))
    return queries.join(arrived, "qid", "left").select("qid", "source", "target", "cost")


def unpack(hierarchy: DataFrame, paths: DataFrame) -> DataFrame:
    """(qid, pos, src, dst) of original edges from paths of (qid, pos, src, dst) over shortcuts.

    Each round replaces every shortcut by its two halves; ``pos`` is an array
    of integers that keeps the order.  A half ranks below its shortcut, so the
    rounds end.
    """
    via = hierarchy.select("src", "dst", "via")
    open_, done = paths.select("qid", F.array("pos").alias("pos"), "src", "dst"), None
    while True:
        met = cut(open_.join(via, ["src", "dst"]))
        ready = met.where("via is null").select("qid", "pos", "src", "dst")
        done = ready if done is None else done.unionByName(ready)
        halves = F.explode(F.array(F.struct(F.concat("pos", F.array(F.lit(0))).alias("pos"), F.col("src"), F.col("via").alias("dst")), F.struct(F.concat("pos", F.array(F.lit(1))).alias("pos"), F.col("via").alias("src"), F.col("dst"))))
        open_ = met.where("via is not null").select("qid", halves.alias("h")).select("qid", "h.*")
        if open_.isEmpty():
            return done


def paths(hierarchy: DataFrame, ranks: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, pos, src, dst): the original edges of a shortest path of each query, ``pos`` in their order; none where there is no path."""
    trees = cut(relax(two_phase_edges(hierarchy, ranks), queries.select("qid", _state(F.col("source"), F.lit(True)).alias("node"))))
    ends = trees.join(queries.select("qid", "target"), "qid").where(F.floor(F.col("node") / 2) == F.col("target"))
    ends = ends.groupBy("qid").agg(F.min(F.struct("g", "node")).alias("s")).select("qid", F.col("s.node").alias("target"))
    found = extract_paths(trees, ends).select("qid", F.transform("path", lambda n: F.floor(n / 2).cast("bigint")).alias("path"))
    steps = found.select("qid", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("pos", "src"), "path").select("qid", "pos", "src", F.expr("path[pos + 1]").alias("dst"))
    return unpack(hierarchy, steps)


def end_directions(hierarchy: DataFrame, directions: DataFrame) -> DataFrame:
    """(src, dst, first, last): directions of the first and last original edge of every edge; ``directions`` has src, dst, dir."""
    numbered = hierarchy.select(F.struct("src", "dst").alias("qid"), F.lit(0).alias("pos"), "src", "dst")
    plain = unpack(hierarchy, numbered).join(directions, ["src", "dst"])
    ends = plain.groupBy("qid").agg(F.min(F.struct("pos", "dir")).alias("a"), F.max(F.struct("pos", "dir")).alias("b"))
    return ends.select("qid.src", "qid.dst", F.col("a.dir").alias("first"), F.col("b.dir").alias("last"))
