"""Shortest paths by min-plus relaxation of DataFrames.

Edges are written once in buckets of their source (``Network``), the state
``dist(qid, node, g, pred)`` in buckets of (qid, node): one table and the
improvements since.  A round joins the frontier with the edges, which moves the
frontier; takes the least cost for every (qid, node), which moves the new steps;
and compares them with the state where it lies.  It is one job, which writes the
rows that improved and says how many there are.  Rows that found a cheaper path
are the next frontier; a smaller predecessor at equal cost is kept but not
followed again, so results do not depend on partitioning.

With ``delta`` a round takes only rows that cost at most ``delta`` more than the
cheapest open row of their query (delta-stepping): the others wait, and many are
improved before they are expanded.  What costs less than all open rows is
settled.  Edge filters are plain predicates on the edge table: they run below
the join.  Weights must not be negative.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pathloom.plans.lineage import cut, dealt

#: Improvements that are read beside the table before they are merged into it.
PENDING = 4
#: Edges of one source in one bucket, about; sources with more are spread.
MOST_EDGES = 1_000_000
_SCHEMA = ("qid", "node", "g", "pred")


@dataclass(frozen=True)
class Network:
    """Edges in buckets of (src, part); ``heavy`` has the number of parts of sources with more than one."""

    edges: DataFrame
    heavy: DataFrame | None

    @staticmethod
    def of(edges: DataFrame | Network, most_edges: int = MOST_EDGES) -> Network:
        """The edges (src, dst, wt and others) dealt out once, for any number of searches."""
        if isinstance(edges, Network):
            return edges
        plain = dealt(edges, "src")
        # Counted where they lie: a plan that Spark sees to be empty observes nothing.
        if plain.count() <= most_edges:
            return Network(plain, None)
        degree = plain.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_edges)
        if degree.isEmpty():
            return Network(plain, None)
        heavy = cut(degree.select("src", F.ceil(F.col("n") / most_edges).cast("int").alias("parts")))
        wide = plain.join(heavy, "src", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")), F.lit(0)).cast("int"))
        return Network(dealt(wide.drop("parts"), "src", "part"), heavy)

    def steps(self, frontier: DataFrame) -> DataFrame:
        """Rows of ``frontier`` (with a node) beside every edge from there."""
        if self.heavy is None:
            return frontier.join(self.edges, F.col("node") == F.col("src"))
        wide = frontier.join(self.heavy.withColumnRenamed("src", "node"), "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return wide.withColumnRenamed("part", "to_part").join(self.edges, (F.col("node") == F.col("src")) & (F.col("to_part") == F.col("part"))).drop("to_part", "part")

    def degrees(self) -> DataFrame:
        """(node, degree) of all sources."""
        return self.edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


class State:
    """Least costs found so far, in buckets of (qid, node); with ``preds`` the smallest predecessors as well.

    Costs alone are least values of one number, which group by hash; with predecessors rows must be sorted.
    """

    def __init__(self, nodes: DataFrame, preds: bool = True) -> None:
        start = nodes.select("qid", "node", F.lit(0).cast("bigint").alias("g"), F.lit(None).cast("bigint").alias("pred")).dropDuplicates(["qid", "node"])
        self.preds, self.parts = preds, [dealt(start, "qid", "node")]
        self._value = F.struct(F.col("g").cast("bigint").alias("g"), F.col("pred").cast("bigint").alias("pred")) if preds else F.col("g").cast("bigint")

    def _cost(self, value: str) -> Column:
        return F.col(value)["g"] if self.preds else F.col(value)

    def _pred(self, value: Column) -> Column:
        return value["pred"] if self.preds else F.lit(None).cast("bigint")

    def rows(self) -> DataFrame:
        """All rows, those that were improved later included."""
        return reduce(DataFrame.unionByName, self.parts)

    def best(self) -> DataFrame:
        if len(self.parts) == 1:
            return self.parts[0]
        least = self.rows().groupBy("qid", "node").agg(F.min(self._value).alias("s"))
        return least.select("qid", "node", self._cost("s").alias("g"), self._pred(F.col("s")).alias("pred"))

    def improve(self, steps: DataFrame, held: DataFrame | None = None) -> tuple[DataFrame, int]:
        """Take in (qid, node, g, pred); (rows that are better than before, or ``held``; how many are to be expanded).

        ``fresh`` tells better rows, ``new`` those of nodes not reached before, ``go`` those to be expanded.  Null
        predecessors (sources) sort first and so are never replaced at equal cost.
        """
        # Steps come grouped by (qid, node), so that they lie like the state, which is only probed.
        keys = ["qid", "node"]
        least = steps.groupBy(*keys).agg(F.min(self._value).alias("n"))
        seen = least
        for i, part in enumerate(self.parts):
            seen = seen.hint("shuffle_hash").join(part.select(*keys, self._value.alias(f"o{i}")), keys, "left")
        known = [F.col(f"o{i}") for i in range(len(self.parts))]
        seen = seen.select(*keys, "n", (F.least(*known) if len(known) > 1 else known[0]).alias("o")).where("o is null or n < o")
        out = seen.select(
            *keys, self._cost("n").alias("g"), self._pred(F.col("n")).alias("pred"), F.lit(True).alias("fresh"), F.col("o").isNull().alias("new"),
            (F.col("o").isNull() | (self._cost("n") < self._cost("o"))).alias("go"),
        )
        if held is not None:
            stays = held.join(least.select(*keys, self._cost("n").alias("to")), keys, "left").where("to is null or to >= g")
            out = out.unionByName(stays.select(*_SCHEMA, *(F.lit(x).alias(c) for c, x in (("fresh", False), ("new", False), ("go", True)))))
        told = Observation()
        better = dealt(out.observe(told, F.count(F.when(F.col("go"), 1)).alias("go")), "qid", "node", spread=False)
        if len(self.parts) > PENDING:
            self.parts = [dealt(self.best(), "qid", "node", spread=False)]
        self.parts.append(better.where("fresh").select(*_SCHEMA))
        return better, told.get["go"]


def relax(
    edges: DataFrame | Network,
    sources: DataFrame,
    max_rounds: int | None = None,
    cutoff: float | None = None,
    goals: DataFrame | None = None,
    context: DataFrame | None = None,
    keep: Column | None = None,
    estimate: Column | None = None,
    on_expand: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    on_generate: Callable[[DataFrame], DataFrame] | None = None,
    on_relax: Callable[[DataFrame], DataFrame] | None = None,
    delta: float | None = None,
    max_settled: int | None = None,
    trace: list[tuple[DataFrame, DataFrame]] | None = None,
    preds: bool = True,
) -> DataFrame:
    """(qid, node, g, pred) of every node reached from the sources (qid, node); without ``preds``, pred is null.

    ``max_rounds`` bounds the number of edges of a path, ``cutoff`` its cost.
    With ``goals`` (qid, node), rows that cost as much as the dearest goal of
    their query, once all are reached, are not followed; ``estimate``, a lower
    bound of what a step still lacks to its goal, sharpens that.  ``keep`` is a
    predicate on a step: columns of its edge and of ``context``, one row for
    each qid.  Hooks see, and may thin out, the rows to expand (with the state),
    the steps generated and the rows that improved.  ``delta``: of a round, see
    above; ``max_settled`` ends a query once so many nodes are settled.
    ``trace`` takes (rows expanded, rows that improved) of every round.
    """
    if max_rounds is not None and delta is not None:
        raise ValueError("rounds count edges of a path only without delta")
    net, state = Network.of(edges), State(sources, preds)
    goals = None if goals is None else dealt(goals.select("qid", "node"), "qid", "node")
    frontier, done = state.parts[0], 0
    while max_rounds is None or done < max_rounds:
        open_ = frontier
        if goals is not None:
            found = goals.join(state.rows().select("qid", "node", "g"), ["qid", "node"], "left").groupBy("qid", "node").agg(F.min("g").alias("g"))
            limit = found.groupBy("qid").agg(F.max("g").alias("limit"), F.max(F.col("g").isNull()).alias("missing")).where("not missing").select("qid", "limit")
            open_ = open_.join(limit, "qid", "left").where("limit is null or g < limit")
        if on_expand is not None:
            open_ = on_expand(open_, state.best())
        held = None
        if delta is not None or max_settled is not None:
            least = open_.groupBy("qid").agg(F.min("g").alias("least"))
            if max_settled is not None:
                settled = state.best().join(least, "qid").where("g < least").groupBy("qid").agg(F.count(F.lit(1)).alias("settled"))
                least = least.join(settled, "qid", "left").where(F.coalesce("settled", F.lit(0)) < max_settled).drop("settled")
            open_ = open_.join(least, "qid")
            if delta is not None:
                held = open_.where(F.col("g") > F.col("least") + delta).select(*_SCHEMA)
                open_ = open_.where(F.col("g") <= F.col("least") + delta)
            open_ = open_.drop("least")
        expanded = open_.select(*_SCHEMA)
        if context is not None:
            open_ = open_.join(context, "qid")
        steps = net.steps(open_).withColumn("cost", F.col("g") + F.col("wt"))
        if keep is not None:
            steps = steps.where(keep)
        if cutoff is not None:
            steps = steps.where(F.col("cost") <= cutoff)
        if goals is not None:
            ahead = F.col("cost") if estimate is None else F.col("cost") + estimate
            steps = steps.where(F.col("limit").isNull() | (ahead <= F.col("limit")))
        if on_generate is not None:
            steps = on_generate(steps)
        better, going = state.improve(steps.select("qid", F.col("dst").alias("node"), F.col("cost").alias("g"), F.col("src").alias("pred")), held)
        if trace is not None:
            trace.append((expanded, better))
        frontier = better.where("go").select(*_SCHEMA)
        if on_relax is not None:
            frontier = on_relax(frontier)
        done += 1
        if not going or (on_relax is not None and frontier.isEmpty()):
            break
    return state.best()


def counters(edges: Network, trace: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(qid, expanded, generated, inserted, updated): what a search has done for each query, from its ``trace``.

    generated counts all edges of expanded rows.
    """
    degree, parts = edges.degrees(), []
    for expanded, better in trace:
        work = expanded.join(degree, "node", "left").select("qid", F.lit(1).alias("expanded"), F.coalesce("degree", F.lit(0)).alias("generated"), F.lit(0).alias("inserted"), F.lit(0).alias("updated"))
        made = better.where("fresh and (new or go)").select("qid", F.lit(0).alias("expanded"), F.lit(0).alias("generated"), F.col("new").cast("int").alias("inserted"), (~F.col("new")).cast("int").alias("updated"))
        parts += [t.groupBy("qid").agg(*(F.sum(c).alias(c) for c in ("expanded", "generated", "inserted", "updated"))) for t in (work, made)]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("qid").agg(*(F.sum(c).alias(c) for c in ("expanded", "generated", "inserted", "updated")))


def events(trace: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(qid, round, kind, node, g, pred) of a search's ``trace``: expanding, inserting and updating."""
    parts = []
    for i, (expanded, better) in enumerate(trace):
        parts.append(expanded.select("qid", F.lit(i).alias("round"), F.lit("expanding").alias("kind"), "node", "g", "pred"))
        kind = F.when(F.col("new"), "inserting").otherwise("updating")
        parts.append(better.where("fresh and (new or go)").select("qid", F.lit(i).alias("round"), kind.alias("kind"), "node", "g", "pred"))
    return reduce(DataFrame.unionByName, parts)


def bounded(edges: DataFrame | Network, sources: DataFrame, max_expanded: int, delta: float | None = None) -> DataFrame:
    """(qid, node, g, expanded): a search that ends after ``max_expanded`` expansions of each query.

    Nodes are expanded by (cost, node); the others are neighbours of these, at
    the least cost over them.
    """
    net = Network.of(edges)
    trees = cut(relax(net, sources, delta=delta, max_settled=max_expanded, preds=False))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("g", "node"))
    first = cut(trees.withColumn("place", place).where(F.col("place") <= max_expanded).select("qid", "node", "g"))
    near = net.steps(first).select("qid", F.col("dst").alias("node"), (F.col("g") + F.col("wt")).alias("g"), F.lit(False).alias("expanded"))
    both = first.select("qid", "node", "g", F.lit(True).alias("expanded")).unionByName(near)
    return both.groupBy("qid", "node").agg(F.min("g").alias("g"), F.max("expanded").alias("expanded"))


def single_source(edges: DataFrame, source: int, **bounds) -> DataFrame:
    """(node, g, pred) of the tree from one node."""
    start = edges.sparkSession.createDataFrame([(0, source)], "qid bigint, node bigint")
    return relax(edges, start, **bounds).drop("qid")


def point_to_point(edges: DataFrame, queries: DataFrame, **bounds) -> DataFrame:
    """(qid, source, target, cost) of every query (qid, source, target); null cost where there is no path.

    Queries with one source share its tree, which ends where their targets are settled.
    """
    trees = relax(
        edges, queries.select(F.col("source").alias("qid"), F.col("source").alias("node")).distinct(),
        goals=queries.select(F.col("source").alias("qid"), F.col("target").alias("node")).distinct(), preds=False, **bounds,
    )
    found = trees.select(F.col("qid").alias("source"), F.col("node").alias("target"), F.col("g").alias("cost"))
    return queries.join(found, ["source", "target"], "left").select("qid", "source", "target", "cost")


def goal_directed(edges: DataFrame, nodes: DataFrame, queries: DataFrame, **bounds) -> DataFrame:
    """As ``point_to_point``, each query on its own, by cost plus straight-line distance; ``nodes`` has id, x, y.

    Weights must be no less than the distance between their ends.
    """
    at = nodes.select(F.col("id").alias("dst"), F.col("x").alias("ex"), F.col("y").alias("ey"))
    goal = queries.join(nodes.select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty")), "target").select("qid", "tx", "ty")
    left = F.sqrt(F.pow(F.col("ex") - F.col("tx"), 2) + F.pow(F.col("ey") - F.col("ty"), 2))
    # Rounding must not turn an estimate into more than there is.
    trees = relax(
        edges.select("src", "dst", "wt").join(at, "dst"), queries.select("qid", F.col("source").alias("node")),
        goals=queries.select("qid", F.col("target").alias("node")), context=goal, estimate=F.floor(left - 1e-9), preds=False, **bounds,
    )
    found = trees.select("qid", F.col("node").alias("target"), F.col("g").alias("cost"))
    return queries.join(found, ["qid", "target"], "left").select("qid", "source", "target", "cost")


def distances_to(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, node, g): the exact rest from every node to each target (column target); the heuristic that is never wrong."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "wt")
    return relax(back, targets.select(F.col("target").alias("qid"), F.col("target").alias("node")), preds=False).select(F.col("qid").alias("target"), "node", "g")


def meet_in_middle(edges: DataFrame, back: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, source, target, cost) by forward and backward trees joined where they meet; null cost where there is no path.

    A path that is not found yet leaves both trees at their frontiers, so a
    query is done when the sum of the two frontier minima is no less than its
    best meeting cost, or when a frontier is empty.  Rows that cannot be on a
    cheaper path for the same reason are not followed.
    """
    ahead_of, behind_of = Network.of(edges), Network.of(back)
    fwd, bwd = State(queries.select("qid", F.col("source").alias("node")), False), State(queries.select("qid", F.col("target").alias("node")), False)
    ahead, behind = fwd.parts[0], bwd.parts[0]

    def grown(state: State, net: Network, frontier: DataFrame) -> DataFrame:
        found = net.steps(frontier.select(*_SCHEMA)).select("qid", F.col("dst").alias("node"), (F.col("g") + F.col("wt")).alias("g"), F.col("src").alias("pred"))
        return state.improve(found)[0].where("go").select(*_SCHEMA)

    while True:
        met = fwd.best().select("qid", "node", F.col("g").alias("gf")).join(bwd.best().select("qid", "node", F.col("g").alias("gb")), ["qid", "node"])
        best = met.groupBy("qid").agg(F.min(F.col("gf") + F.col("gb")).alias("cost"))
        least = ahead.groupBy("qid").agg(F.min("g").alias("mf")).join(behind.groupBy("qid").agg(F.min("g").alias("mb")), "qid", "full")
        # Queries whose frontiers are empty, on one side at least, are done.
        now = cut(best.join(least, "qid", "full").withColumn("open", F.coalesce(F.col("mf").isNotNull() & F.col("mb").isNotNull() & (F.col("cost").isNull() | (F.col("mf") + F.col("mb") < F.col("cost"))), F.lit(False))))
        open_ = now.where("open")
        if open_.isEmpty():
            return queries.join(now.select("qid", "cost"), "qid", "left").select("qid", "source", "target", "cost")
        ahead, behind = (
            grown(fwd, ahead_of, ahead.join(open_.select("qid", "cost", "mb"), "qid").where("cost is null or g + mb < cost")),
            grown(bwd, behind_of, behind.join(open_.select("qid", "cost", "mf"), "qid").where("cost is null or g + mf < cost")),
        )


def extract_paths(dist: DataFrame, ends: DataFrame) -> DataFrame:
    """(qid, target, path) from the node where the tree starts to each end (qid, target).

    By pointer doubling: round k knows every node's ancestor 2**k edges up, and
    with it doubles the rows of every path, so rounds grow with the logarithm
    of the longest path.
    """
    jump = cut(dist.where("pred is not null").select("qid", "node", F.col("pred").alias("up")))
    here = ends.select("qid", "target", F.col("target").alias("node")).distinct().join(dist, ["qid", "node"], "left_semi")
    parts, k = [cut(here.select("qid", "target", F.lit(0).cast("bigint").alias("pos"), "node"))], 0
    while True:
        told = Observation()
        above = reduce(DataFrame.unionByName, parts).join(jump, ["qid", "node"]).select("qid", "target", (F.col("pos") + (1 << k)).alias("pos"), F.col("up").alias("node"))
        parts.append(cut(above.observe(told, F.count(F.lit(1)).alias("n"))))
        if not told.get["n"]:
            break
        jump = cut(jump.join(jump.select("qid", F.col("node").alias("up"), F.col("up").alias("top")), ["qid", "up"]).select("qid", "node", F.col("top").alias("up")))
        k += 1
    rows = reduce(DataFrame.unionByName, parts).groupBy("qid", "target").agg(F.sort_array(F.collect_list(F.struct((-F.col("pos")).alias("back"), "node"))).alias("rows"))
    return rows.select("qid", "target", F.col("rows.node").alias("path"))


def deepening(edges: DataFrame, source: int, bounds: list[float]) -> DataFrame:
    """(node, bound): the first cost bound of a growing list under which each node is reached.

    A round of bound takes up the rows that the round before left above its own.
    """
    start = edges.sparkSession.createDataFrame([(0, source)], "qid bigint, node bigint")
    net, state, out = Network.of(edges), State(start, False), None
    frontier, going = state.parts[0], 1
    for bound in sorted(bounds):
        held = None
        while going:
            steps = net.steps(frontier).select("qid", F.col("dst").alias("node"), (F.col("g") + F.col("wt")).alias("g"), F.col("src").alias("pred"))
            better, going = state.improve(steps)
            better = better.where("go").select(*_SCHEMA)
            late = better.where(F.col("g") > bound)
            held = late if held is None else held.unionByName(late)
            frontier = better.where(F.col("g") <= bound)
        level = state.best().where(F.col("g") <= bound).select("node", F.lit(bound).alias("bound"))
        out = level if out is None else out.unionByName(level)
        # Of the rows held back, those that were not improved since.
        frontier = cut(held.join(state.best(), list(_SCHEMA[:3]), "left_semi").where("g is not null").select(*_SCHEMA)) if held is not None else frontier
        going = 1
    return out.groupBy("node").agg(F.min("bound").alias("bound"))


def optimal_first_edges(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(source, node, first): every first edge's head of an optimal path, ties kept.

    ``dist`` has all trees (qid = source, node, g).  A first edge (s, f) is
    optimal for t when wt(s, f) + d(f, t) = d(s, t).
    """
    d = dist.select(F.col("qid").alias("source"), "node", "g")
    via = d.select(F.col("source").alias("first"), "node", F.col("g").alias("rest"))
    out = edges.select(F.col("src").alias("source"), F.col("dst").alias("first"), "wt")
    both = out.join(via, "first").join(d, ["source", "node"]).where("wt + rest = g and source <> node")
    return both.select("source", "node", "first")
