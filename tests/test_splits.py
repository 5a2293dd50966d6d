"""Formats with counted lines, read in many splits and from many files."""

import random

import pytest

from pathloom.sources import readers


@pytest.fixture
def small_splits(spark):
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, "256")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def test_lines_of_one_file_and_of_a_folder(spark, tmp_path, small_splits):
    rng = random.Random(1)
    texts = {f"part-{i:05d}-x": ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 30))) for _ in range(rng.choice((0, 1, 200, 400)))] for i in range(5)}
    texts["part-00005-x"] = ["y" * 900, "", "z"] * 3
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
    text = readers._split_lines(spark, str(tmp_path))
    assert text.select("start").distinct().count() > 20
    got = sorted((r["line"], r["value"]) for r in readers.lines(spark, str(tmp_path), joined=True).collect())
    assert got == list(enumerate(x for name in sorted(texts) for x in texts[name]))
    each = {}
    for r in readers.lines(spark, str(tmp_path)).collect():
        each.setdefault(r["file"].rsplit("/", 1)[1], {})[r["line"]] = r["value"]
    assert each == {name: dict(enumerate(lines)) for name, lines in texts.items() if lines}


def test_orders_parts_and_maps(spark, tmp_path, small_splits):
    rng = random.Random(2)
    order = rng.sample(range(700), 700)
    (tmp_path / "o").write_text("# order\n" + "".join(f"{n}\n" for n in order))
    assert {r["rank"]: r["node"] for r in readers.node_order(spark, f"{tmp_path}/o").collect()} == dict(enumerate(order))
    assert {r["node"]: r["rank"] for r in readers.node_order(spark, f"{tmp_path}/o", inverted=True).collect()} == dict(enumerate(order))
    assert {r["node"]: r["part"] for r in readers.partition_labels(spark, f"{tmp_path}/o", first=1).collect()} == {i + 1: n for i, n in enumerate(order)}
    tiles = [[rng.choice(".@GT") for _ in range(37)] for _ in range(90)]
    body = "".join("".join(row) for row in tiles)
    for name, lines in (("rows", ["".join(r) for r in tiles]), ("broken", [body[i : i + 50] for i in range(0, len(body), 50)])):
        (tmp_path / f"{name}.map").write_text("\n".join(["type octile", "width 37", "height 90", "map", *lines]) + "\n")
    got = {}
    for r in readers.grid_map(spark, f"{tmp_path}/*.map").collect():
        got.setdefault(r["map"], {})[r["x"], r["y"]] = r["tile"]
    want = {(x, y): t for y, row in enumerate(tiles) for x, t in enumerate(row)}
    assert got == {"rows.map": want, "broken.map": want}
    (tmp_path / "short.map").write_text("type octile\nheight 2\nwidth 3\nmap\n...\n..\n")
    with pytest.raises(Exception, match="wrong number of tiles"):
        readers.grid_map(spark, f"{tmp_path}/short.map").collect()
