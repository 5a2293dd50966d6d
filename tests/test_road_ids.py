"""Road queries where a part has the number of a supplier's node, as tables with more than a million parts have."""

import duckdb

from pathloom.plans import catalog, shapes
from tests.oracle import rows_of


def test_core_keeps_the_loops_that_shared_numbers_make(spark, tmp_path):
    n = shapes.SUPPLIERS
    rows = [(n + 1, 1), (n + 1, 2), (n + 2, 1), (n + 3, 3), *((p, s) for p in range(8) for s in range(1 + p % 4))]
    lines = spark.createDataFrame([(p, s, float(1 + (p * 7 + s) % 50)) for p, s in rows], "l_partkey bigint, l_suppkey bigint, l_quantity double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("core_road", "undirected_road", "degrees_road"):
        want = con.sql(catalog.oracle_sql()[name]).df()
        assert rows_of(catalog.queries()[name](spark, str(tmp_path)).toPandas()) == rows_of(want), name
