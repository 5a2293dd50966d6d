"""Mesh and polygon formats: bad files, packed numbers, several files; end directions of shortcuts."""

import pytest
from pyspark.sql import functions as F

from pathloom.operators import hierarchy
from pathloom.sources import meshes, tables

SQUARE = "mesh 2 4 1 0 0 2 0 -1 1 0 2 0 -1 1 1 2 0 -1 0 1 2 0 -1 4 0 1 2 3 -1 -1 -1 -1".split()


@pytest.mark.parametrize("words", [["mesh", "3"], SQUARE[:-1], [*SQUARE, "1"], [w if i != 6 else "1" for i, w in enumerate(SQUARE)], [w if i != 24 else "2" for i, w in enumerate(SQUARE)], [w if i != 25 else "9" for i, w in enumerate(SQUARE)]])
def test_bad_meshes_are_refused(words):
    with pytest.raises(ValueError):
        meshes.parse_mesh(words)


@pytest.mark.parametrize("words", [["poly", "2", "1"], ["poly", "1", "0"], ["poly", "1", "1", "2", "0", "0", "1", "1"], ["poly", "1", "1", "3", "0", "0", "1", "1", "1"], "poly 1 1 3 0 0 1 0 1 1 5".split()])
def test_bad_polygon_maps_are_refused(words):
    with pytest.raises(ValueError):
        meshes.parse_polymap(words)


def test_packing():
    assert meshes.unpack(meshes.pack(SQUARE)) == SQUARE and len(meshes.pack(SQUARE)) == 4 + 3 * (len(SQUARE) - 1)
    for words in (["mesh", "0.5"], ["mesh", str(2**24)], ["poly"]):
        with pytest.raises(ValueError):
            meshes.pack(words)
    with pytest.raises(ValueError):
        meshes.unpack(b"nope")
    vertices, polygons = meshes.parse_mesh(SQUARE)
    assert meshes.mesh_words(vertices, polygons) == SQUARE


def test_all_files_of_a_folder_are_read(spark, tmp_path):
    for name in ("a.mesh", "b.mesh"):
        (tmp_path / name).write_text("\n".join(SQUARE))
    vertices, polygons = meshes.read_mesh(spark, str(tmp_path))
    assert sorted(r["file"] for r in polygons.collect()) == ["a.mesh", "b.mesh"] and vertices.count() == 8


def test_saved_tables_are_checked(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 2, 3)], "id bigint, x bigint, y bigint")
    tables.save(nodes, str(tmp_path), "nodes")
    assert tables.load(spark, str(tmp_path), "nodes").collect() == nodes.collect()
    with pytest.raises(ValueError):
        tables.save(nodes, str(tmp_path), "edges")


def test_end_directions_of_shortcuts(spark):
    built = spark.createDataFrame([(0, 1, 1, None), (1, 2, 1, None), (2, 3, 1, None), (0, 2, 2, 1), (0, 3, 3, 2)], "src bigint, dst bigint, wt bigint, via bigint")
    directions = spark.createDataFrame([(0, 1, "N"), (1, 2, "E"), (2, 3, "S")], "src bigint, dst bigint, dir string")
    got = {(r["src"], r["dst"]): (r["first"], r["last"]) for r in hierarchy.end_directions(built, directions).collect()}
    assert got == {(0, 1): ("N", "N"), (1, 2): ("E", "E"), (2, 3): ("S", "S"), (0, 2): ("N", "E"), (0, 3): ("N", "S")}


def test_no_machine_local_folder_on_a_cluster(spark):
    from unittest.mock import MagicMock

    from pathloom.plans.lineage import shared_dir

    session = MagicMock()
    session.conf.get.return_value = None
    session.sparkContext.getCheckpointDir.return_value = None
    session.sparkContext.master = "spark://somewhere:7077"
    with pytest.raises(ValueError):
        shared_dir(session)


def test_files_are_parsed_and_written_in_batches(spark, tmp_path, monkeypatch):
    from itertools import islice

    # A stream of words gives its first rows before the rest is read.
    feed = iter(SQUARE)
    assert [row[0] for _, row in islice(meshes.mesh_records(feed), 2)] == [0, 1] and len(list(feed)) == len(SQUARE) - 14
    assert [row[0] for row in islice(meshes.polymap_records(iter("poly 1 2 3 0 0 1 0 1 1 3".split())), 1)] == [0]
    monkeypatch.setattr(meshes, "BATCH", 3)
    (tmp_path / "in").mkdir()
    for name in ("a.mesh", "b.mesh"):
        (tmp_path / "in" / name).write_text("\n".join(SQUARE) if name == "a.mesh" else " ".join(SQUARE[:7]) + "\n\n" + " ".join(SQUARE[7:]) + "\n")
    vertices, polygons = meshes.read_mesh(spark, str(tmp_path / "in"))
    for packed in (False, True):
        folder = str(tmp_path / f"out-{packed}")
        sizes = {r["file"]: r["bytes"] for r in meshes.write_mesh(vertices, polygons, folder, packed).collect()}
        for name in ("a.mesh", "b.mesh"):
            raw = (tmp_path / f"out-{packed}" / name).read_bytes()
            assert len(raw) == sizes[name] and (meshes.unpack(raw) if packed else raw.decode().split()) == SQUARE
        again = meshes.read_mesh(spark, folder, packed)
        assert [sorted(t.collect()) for t in again] == [sorted(t.collect()) for t in (vertices, polygons)]
    (tmp_path / "in" / "c.mesh").write_text("mesh 1\n")
    with pytest.raises(Exception, match="not a version 2 mesh"):
        meshes.read_mesh(spark, str(tmp_path / "in"))[0].collect()
