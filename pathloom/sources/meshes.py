"""Meshes and polygon maps as text, and meshes packed in three-byte integers.

The place of a record depends on all before it, so a file is one task's; it is
parsed and written as a stream of batches, and a task holds one batch at a time
(of a packed mesh that is read, the bytes of the file besides).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The packed format's first bytes, and its number for -1.
PACKED, MINUS_ONE = b"pack", 0xFFFFFF

#: Records, and numbers of a packed mesh, that a task holds at once.
BATCH = 10_000

_VERTICES = "file string, vid int, x double, y double, polygons array<int>"
_POLYGONS = "file string, pid int, vertices array<int>, neighbours array<int>"
_RINGS = "file string, pid int, ring array<struct<x:double,y:double>>"


def _header(feed: Iterator, kind: str, version: str) -> None:
    if [str(w) for w in islice(feed, 2)] != [kind, version]:
        raise ValueError(f"not a version {version} {'mesh' if kind == 'mesh' else 'polygon map'}")


def mesh_records(feed: Iterator) -> Iterator[tuple[bool, tuple]]:
    """(whether a vertex, the row) of a version 2 mesh in order, from an iterator over its words; ValueError where the counts, the least sizes or an index are wrong."""
    _header(feed, "mesh", "2")

    def whole(n: int) -> list[int]:
        out = [int(w) for w in islice(feed, n)]
        if len(out) < n:
            raise ValueError("the mesh ends too soon")
        return out

    n_vertices, n_polygons = whole(2)
    for i in range(n_vertices):
        place = [float(w) for w in islice(feed, 2)]
        around = whole(whole(1)[0])
        if len(around) < 2 or min(around) < -1 or max(around) >= n_polygons:
            raise ValueError(f"bad vertex {i}")
        yield True, (i, *place, around)
    for i in range(n_polygons):
        n = whole(1)[0]
        ring, beside = whole(n), whole(n)
        if n < 3 or min(ring) < 0 or max(ring) >= n_vertices or min(beside) < -1 or max(beside) >= n_polygons:
            raise ValueError(f"bad polygon {i}")
        yield False, (i, ring, beside)
    if next(feed, None) is not None:
        raise ValueError("words after the last polygon")


def parse_mesh(words: list[str]) -> tuple[list[tuple], list[tuple]]:
    """(vertices, polygons) of a version 2 mesh."""
    out: tuple[list[tuple], list[tuple]] = [], []
    for vertex, row in mesh_records(iter(words)):
        out[not vertex].append(row)
    return out


def polymap_records(feed: Iterator) -> Iterator[tuple]:
    """(pid, ring) of a version 1 polygon map in order, from an iterator over its words."""
    _header(feed, "poly", "1")
    try:
        n = int(next(feed))
        if n < 1:
            raise ValueError("no polygons")
        for i in range(n):
            m = int(next(feed))
            if m < 3:
                raise ValueError(f"polygon {i} has {m} points")
            ring = [float(w) for w in islice(feed, 2 * m)]
            if len(ring) < 2 * m:
                raise ValueError("the map ends too soon")
            yield i, [{"x": x, "y": y} for x, y in zip(ring[::2], ring[1::2], strict=True)]
    except StopIteration:
        raise ValueError("the map ends too soon") from None
    if next(feed, None) is not None:
        raise ValueError("words after the last polygon")


def parse_polymap(words: list[str]) -> list[tuple]:
    """(pid, ring) of a version 1 polygon map."""
    return list(polymap_records(iter(words)))


def unpack(raw: bytes) -> list[str]:
    """The words of a packed mesh."""
    if raw[:4] != PACKED:
        raise ValueError("not a packed mesh")
    numbers = (int.from_bytes(raw[i : i + 3], "big") for i in range(4, len(raw) - 2, 3))
    return ["mesh", *("-1" if n == MINUS_ONE else str(n) for n in numbers)]


def pack(words: list[str]) -> bytes:
    """A mesh whose numbers are all whole, from -1 to 0xFFFFFE, in three bytes each."""
    if words[:1] != ["mesh"]:
        raise ValueError("not a mesh")
    numbers = [float(w) for w in words[1:]]
    if any(n != int(n) or not -1 <= n < MINUS_ONE for n in numbers):
        raise ValueError("a number does not fit three bytes")
    return PACKED + b"".join((MINUS_ONE if n == -1 else int(n)).to_bytes(3, "big") for n in numbers)


def _plain(v: float) -> str:
    return str(int(v)) if v == int(v) else repr(float(v))


def mesh_words(vertices: list[tuple], polygons: list[tuple]) -> list[str]:
    """The words of a mesh from (vid, x, y, polygons) and (pid, vertices, neighbours), in order of their ids from 0."""
    out = ["mesh", "2", str(len(vertices)), str(len(polygons))]
    for _, x, y, around in sorted(vertices, key=lambda v: v[0]):
        out += [_plain(x), _plain(y), str(len(around)), *map(str, around)]
    for _, ring, beside in sorted(polygons, key=lambda p: p[0]):
        out += [str(len(ring)), *map(str, ring), *map(str, beside)]
    return out


def _numbers(raw: bytes) -> Iterator:
    """The words of a packed mesh one after the other, numbers as such."""
    if raw[:4] != PACKED:
        raise ValueError("not a packed mesh")
    yield "mesh"
    digits = np.frombuffer(raw, dtype=np.uint8, offset=4, count=(len(raw) - 4) // 3 * 3).reshape(-1, 3)
    for low in range(0, len(digits), BATCH):
        part = digits[low : low + BATCH].astype(np.int64)
        n = (part[:, 0] << 16) + (part[:, 1] << 8) + part[:, 2]
        yield from np.where(n == MINUS_ONE, -1, n).tolist()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, body): lines of text files, all of one file in one task and in order."""
    from pathloom.sources.readers import _split_lines

    return _split_lines(spark, path).repartition("file").sortWithinPartitions("file", "start", "at").select("file", F.col("value").alias("body"))


def _parsed(files: DataFrame, words: Callable, rows: Callable, schema: str) -> DataFrame:
    """What ``rows`` makes of the ``words`` of the bodies of every file, one after the other."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = chain.from_iterable(zip(b["file"], b["body"], strict=True) for b in batches)
        for path, bodies in groupby(every, key=lambda r: r[0]):
            name, found = path.rsplit("/", 1)[-1], rows(chain.from_iterable(words(body) for _, body in bodies))
            while part := [(name, *row) for row in islice(found, BATCH)]:
                yield pd.DataFrame(part, columns=columns)

    return files.mapInPandas(run, schema)


def read_mesh(spark: SparkSession, path: str, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices(file, vid, x, y, polygons), polygons(file, pid, vertices, neighbours)) of the meshes under a path; a bad mesh fails."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").alias("body")) if packed else _lines(spark, path)
    of = lambda kind: lambda feed: (row for vertex, row in mesh_records(feed) if vertex == kind)
    return tuple(_parsed(files, _numbers if packed else str.split, of(kind), schema) for kind, schema in ((True, _VERTICES), (False, _POLYGONS)))


def read_polymap(spark: SparkSession, path: str) -> DataFrame:
    """(file, pid, ring) of the polygon maps under a path."""
    return _parsed(_lines(spark, path), str.split, polymap_records, _RINGS)


def write_mesh(vertices: DataFrame, polygons: DataFrame, path: str, packed: bool = False) -> DataFrame:
    """Write one file for each ``file`` into a folder; returns (file, bytes).

    Records come to the task of their file in order: the counts, the vertices, the polygons.
    """
    from pathloom.plans.lineage import cut
    from pathloom.sources.files import make_folder, whole_file

    make_folder(path)
    none, empty = F.lit(0.0), F.array().cast("array<int>")
    v = vertices.select("file", F.lit(1).alias("kind"), F.col("vid").alias("id"), "x", "y", F.col("polygons").alias("a"), empty.alias("b"))
    p = polygons.select("file", F.lit(2).alias("kind"), F.col("pid").alias("id"), none.alias("x"), none.alias("y"), F.col("vertices").alias("a"), F.col("neighbours").alias("b"))
    count = lambda kind: F.count_if(F.col("kind") == kind).cast("int")
    both = v.unionByName(p)
    head = both.groupBy("file").agg(F.array(count(1), count(2)).alias("a")).select("file", F.lit(0).alias("kind"), F.lit(0).alias("id"), none.alias("x"), none.alias("y"), "a", empty.alias("b"))
    ordered = both.unionByName(head).repartition("file").sortWithinPartitions("file", "kind", "id")

    def words(kind: int, x: float, y: float, a: list, b: list) -> list[str]:
        if kind == 1:
            return [_plain(x), _plain(y), str(len(a)), *map(str, a)]
        return ["mesh", "2", *map(str, a)] if kind == 0 else [str(len(a)), *map(str, a), *map(str, b)]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = chain.from_iterable(b[["file", "kind", "x", "y", "a", "b"]].itertuples(index=False, name=None) for b in batches)
        for name, records in groupby(every, key=lambda r: r[0]):
            size = 0
            with whole_file(f"{path}/{name}") as out:
                while part := [words(*r[1:]) for r in islice(records, BATCH)]:
                    if packed:
                        raw = pack(["mesh", *chain.from_iterable(part[1:] if part[0][0] == "mesh" else part)])[len(PACKED) :]
                        raw = pack(part[0]) + raw if part[0][0] == "mesh" else raw
                    else:
                        raw = (b"\n" if size else b"") + "\n".join(" ".join(r) for r in part).encode()
                    out.write(raw)
                    size += len(raw)
            yield pd.DataFrame([(name, size)], columns=["file", "bytes"])

    return cut(ordered.mapInPandas(write, "file string, bytes long"))


def write_polymap(rings: DataFrame, path: str) -> None:
    """Polygons (pid, ring) as one text file in a folder."""
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    lines = rings.select("pid", F.concat_ws(" ", F.size("ring").cast("string"), F.array_join(F.transform("ring", point), " ")).alias("value"))
    head = rings.agg(F.lit(-1).alias("pid"), F.concat_ws("\n", F.lit("poly"), F.lit("1"), F.count(F.lit(1)).cast("string")).alias("value"))
    head.unionByName(lines).orderBy("pid").coalesce(1).select("value").write.text(path)


def tables_of(rings: DataFrame, file: str = "mesh") -> tuple[DataFrame, DataFrame]:
    """(vertices, polygons) as ``read_mesh`` gives them, from (pid, ring, neighbours) with points as structs.

    Vertices are numbered by place; the polygons around one start with -1 where
    its fan is open.
    """
    from pathloom.operators.graph import dense_rank_by

    corner = rings.select("pid", F.posexplode("ring").alias("i", "p"), "neighbours").select("pid", "i", "p.x", "p.y", F.element_at("neighbours", F.col("i") + 1).alias("ahead"))
    places = dense_rank_by(corner.select("x", "y").distinct(), [F.col("x"), F.col("y")], "place").select("x", "y", (F.col("place") - 1).cast("int").alias("vid"))
    pids = dense_rank_by(rings.select("pid"), [F.col("pid")], "place").select("pid", (F.col("place") - 1).cast("int").alias("number"))
    wide = corner.join(places, ["x", "y"]).join(pids, "pid")
    polygons = wide.groupBy("number").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "vid"))), lambda c: c["vid"]).alias("vertices"))
    known = rings.select("pid", F.posexplode("neighbours").alias("i", "to")).join(pids, "pid").join(pids.select(F.col("pid").alias("to"), F.col("number").alias("n")), "to", "left")
    beside = known.groupBy("number").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("n", F.lit(-1)).alias("n")))), lambda c: c["n"]).alias("neighbours"))
    around = wide.groupBy("vid", "x", "y").agg(F.sort_array(F.collect_set("number")).alias("held"), F.min("ahead").alias("least"))
    vertices = around.select(F.lit(file).alias("file"), "vid", "x", "y", F.when((F.col("least") < 0) | (F.size("held") < 2), F.concat(F.array(F.lit(-1)), "held")).otherwise(F.col("held")).alias("polygons"))
    return vertices, polygons.join(beside, "number").select(F.lit(file).alias("file"), F.col("number").alias("pid"), "vertices", "neighbours")
