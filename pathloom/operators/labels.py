"""Edge labels from all shortest-path trees, and the filters that read them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.plans.lineage import cut, dealt

#: Parts in one word of arc flags; the sign bit stays free.
WORD = 63


def _flags(part: str) -> Column:
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col(part) % WORD).cast("int")))


def _words(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., flags): words of part bits, as many as the highest part of all rows needs."""
    words = rows.groupBy(*keys, F.floor(F.col("part") / WORD).cast("int").alias("word")).agg(_flags("part").alias("bits"))
    last = rows.agg(F.floor(F.max("part") / WORD).cast("int").alias("w")).first()["w"] or 0
    held = words.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("bigint"))).alias("flags"))


def arc_flags(firsts: DataFrame, parts: DataFrame) -> DataFrame:
    """(source, first, flags): bit p % WORD of word p / WORD is set when an optimal path to part p starts with the edge."""
    return _words(firsts.join(parts, "node"), ["source", "first"])


def boxes(firsts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, first, x1, y1, x2, y2): bounds of the nodes reached optimally over the edge."""
    return firsts.join(nodes.withColumnRenamed("id", "node"), "node").groupBy("source", "first").agg(*_box())


def _box() -> list[Column]:
    return [F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2")]


def _ranges() -> list[Column]:
    return [F.min("node").alias("id1"), F.max("node").alias("id2"), F.min("rank").alias("rank1"), F.max("rank").alias("rank2")]


def closure_labels(firsts: DataFrame, nodes: DataFrame, parts: DataFrame, ranks: DataFrame) -> DataFrame:
    """Flags, box, id range and rank range of every first edge."""
    wide = firsts.join(nodes.withColumnRenamed("id", "node"), "node").join(parts, "node").join(ranks, "node")
    return _words(wide, ["source", "first"]).join(wide.groupBy("source", "first").agg(*_box(), *_ranges()), ["source", "first"])


def edge_labels(edges: DataFrame, dist: DataFrame, nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """``edges`` with flags and box of the nodes to which an optimal path starts with the edge; edges that start none go.

    ``dist`` has all trees; edges may be shortcuts.
    """
    from pathloom.operators.search import optimal_first_edges

    firsts = optimal_first_edges(edges.select("src", "dst", "wt"), dist)
    both = arc_flags(firsts, parts).join(boxes(firsts, nodes.select("id", "x", "y")), ["source", "first"])
    return edges.join(both.withColumnsRenamed({"source": "src", "first": "dst"}), ["src", "dst"])


def down_labels(hierarchy: DataFrame, nodes: DataFrame, parts: DataFrame, ranks: DataFrame) -> DataFrame:
    """(src, dst, flags, box, id range, rank range) of every edge of a hierarchy, from reachability along ranks alone.

    A falling edge has the labels of what lies below its head; a climbing one
    those of what can be reached by climbing on from its head and then falling.
    """
    from pathloom.operators.graph import closure_along, down_closure, with_direction

    directed = with_direction(hierarchy.select("src", "dst", "wt"), ranks)
    below = down_closure(hierarchy.select("src", "dst", "wt"), ranks)
    above = closure_along(directed.where("up").select("src", "dst"), ranks.select("node"))
    reach = above.join(below.select(F.col("top").alias("node"), F.col("node").alias("n")), "node").select("top", F.col("n").alias("node")).distinct()
    told = nodes.withColumnRenamed("id", "node").select("node", "x", "y").join(parts, "node").join(ranks, "node")

    def labelled(rows: DataFrame) -> DataFrame:
        wide = rows.join(told, "node")
        return _words(wide, ["top"]).join(wide.groupBy("top").agg(*_box(), *_ranges()), "top").withColumnRenamed("top", "dst")

    falls = directed.where("not up").select("src", "dst").join(labelled(below), "dst")
    return falls.unionByName(directed.where("up").select("src", "dst").join(labelled(reach), "dst"))


def keeps_part(flags: Column, part: Column) -> Column:
    word = F.get(flags, F.floor(part / WORD).cast("int"))
    return F.call_function("shiftright", word, (part % WORD).cast("int")).bitwiseAND(F.lit(1)) == 1


def keeps_box(x: Column, y: Column) -> Column:
    return x.between(F.col("x1"), F.col("x2")) & y.between(F.col("y1"), F.col("y2"))


def keeps_range(value: Column, low: Column, high: Column) -> Column:
    """Both bounds are tested."""
    return value.between(low, high)


def stacked(filters: list[Column]) -> Column:
    """A filter that keeps what all of them keep; no filter keeps everything."""
    out = F.lit(True)
    for f in filters:
        out = out & f
    return out


def keeps_closure(part: bool = True, box: bool = True, ids: bool = True, ranks: bool = True) -> Column:
    """The parts of a closure label that are on, tested on the target's tpart, tx, ty, tid and trank."""
    return stacked([
        f for on, f in (
            (part, keeps_part(F.col("flags"), F.col("tpart"))), (box, keeps_box(F.col("tx"), F.col("ty"))),
            (ids, keeps_range(F.col("tid"), F.col("id1"), F.col("id2"))), (ranks, keeps_range(F.col("trank"), F.col("rank1"), F.col("rank2"))),
        ) if on
    ])


def targets_of(queries: DataFrame, nodes: DataFrame, parts: DataFrame, ranks: DataFrame) -> DataFrame:
    """(qid, tid, tx, ty, tpart, trank): what label filters need to know of each query's target."""
    told = nodes.select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    told = told.join(parts.select(F.col("node").alias("target"), F.col("part").alias("tpart")), "target").join(ranks.select(F.col("node").alias("target"), F.col("rank").alias("trank")), "target")
    return queries.select("qid", "target").join(told, "target").withColumnRenamed("target", "tid")


def split_directions(labelled: DataFrame, ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels of climbing edges, at their tail; labels of falling ones, at their head)."""
    from pathloom.operators.hierarchy import layouts

    return layouts(labelled, ranks)


def move_sets(firsts: DataFrame) -> DataFrame:
    """(source, node, moves): all optimal first heads, ascending."""
    return firsts.groupBy("source", "node").agg(F.sort_array(F.collect_set("first")).alias("moves"))


def compress_rows(sets: DataFrame, order: DataFrame) -> DataFrame:
    """(source, run_start, run_end, move): runs of targets, in the column order, that share a move.

    ``order`` has node and place.  A run goes on while the intersection of its
    sets is not empty; the smallest move left names it.  One group is one
    source's row, bounded by the number of nodes.
    """

    def runs(row: pd.DataFrame) -> pd.DataFrame:
        row = row.sort_values("place")
        out: list[tuple[int, int, int, int]] = []
        start = last = None
        left: set[int] = set()
        for place, moves in zip(row["place"], row["moves"], strict=True):
            both = left & set(moves)
            if start is not None and both and place == last + 1:
                left, last = both, place
                continue
            if start is not None:
                out.append((row["source"].iloc[0], start, last, min(left)))
            start, last, left = place, place, set(moves)
        if start is not None:
            out.append((row["source"].iloc[0], start, last, min(left)))
        return pd.DataFrame(out, columns=["source", "run_start", "run_end", "move"])

    return sets.join(order, "node").groupBy("source").applyInPandas(runs, "source bigint, run_start bigint, run_end bigint, move bigint")


def run_bins(runs: DataFrame) -> DataFrame:
    """(source, level, bin, run_start, run_end, move): every run in the bins that it meets, on the level whose bins are as long as the run.

    Bins of level k are 2**k places long, so a run is in two bins at most, and a
    place meets few runs of its bin on any level.
    """
    level = F.ceil(F.log2((F.col("run_end") - F.col("run_start") + 1).cast("double"))).cast("int")
    at = lambda c: F.call_function("shiftright", F.col(c), F.col("level"))
    return runs.withColumn("level", level).withColumn("bin", F.explode(F.array_distinct(F.array(at("run_start"), at("run_end"))))).select("source", "level", "bin", "run_start", "run_end", "move")


def follow_moves(runs: DataFrame, order: DataFrame, queries: DataFrame, there: Column | str = "at = target") -> DataFrame:
    """(qid, path) of queries (qid, source, target), by repeated range look-ups in the runs; null if the target is not met.

    Each step is a range join by bins: it meets the runs of the current node that
    share a bin with the target, on every level that has runs, not all runs of
    the node.  Runs lie in buckets of their node, so a step moves the queries
    only.  Moves are optimal, so with positive weights no path comes back.
    ``there`` tells when a row has arrived, where runs are of other things than nodes.
    """
    bins = dealt(run_bins(runs).withColumnRenamed("source", "at"), "at")
    levels = sorted(r["level"] for r in bins.select("level").distinct().collect())  # the logarithm of the longest run
    open_ = queries.join(order.withColumnRenamed("node", "target"), "target").select("qid", "target", "place", F.col("source").alias("at"), F.array("source").alias("path"))
    there = F.expr(there) if isinstance(there, str) else there
    done = open_.where(there).select("qid", "path")
    open_ = open_.where(~there)
    while levels:
        wide = open_.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("bin", F.call_function("shiftright", F.col("place").cast("bigint"), F.col("level")))
        step = wide.join(bins, ["at", "level", "bin"]).where("place between run_start and run_end")
        step = cut(step.select("qid", "target", "place", F.col("move").alias("at"), F.concat("path", F.array("move")).alias("path")))
        done = done.unionByName(step.where(there).select("qid", "path"))
        open_ = step.where(~there)
        if open_.isEmpty():
            break
    return queries.select("qid").join(done, "qid", "left")


def dfs_order(edges: DataFrame, root: int, seed: int = 0) -> DataFrame:
    """(node, place): preorder of a depth-first walk from ``root``, then from the least node left; a column order for ``compress_rows``.

    ``seed`` 0 visits neighbours by id, any other in an order mixed by it.  A
    walk is sequential, so the pairs of one graph are one group's rows in one
    task, as edges of a graph that is labelled for all pairs are.
    """
    def walk(pairs: pd.DataFrame) -> pd.DataFrame:
        around: dict[int, list[tuple[int, int]]] = {}
        for a, b, k in zip(pairs["src"].tolist(), pairs["dst"].tolist(), pairs["k"].tolist(), strict=True):
            around.setdefault(a, []).append((k, b))
            around.setdefault(b, [])
        left, out = dict.fromkeys(sorted(around)), []
        starts = [root] if root in left else []
        while left:
            stack = starts or [next(iter(left))]
            starts = []
            while stack:
                at = stack.pop()
                if at in left:
                    del left[at]
                    out.append(at)
                    stack += [b for _, b in sorted(around[at], reverse=True) if b in left]
        return pd.DataFrame({"node": out, "place": range(len(out))}).astype("int64")

    k = F.col("dst") if not seed else F.xxhash64("dst", F.lit(seed))
    return edges.select("src", "dst", k.alias("k"), F.lit(0).alias("all")).groupBy("all").applyInPandas(walk, "node bigint, place bigint")


