"""Named queries over the reference tables and their SQL oracles."""

from __future__ import annotations

from pathloom.plans import graph_queries, grid_queries, io_queries, result_queries, search_queries

MODULES = (graph_queries, grid_queries, result_queries, search_queries, io_queries)


def queries() -> dict:
    return {name: function for module in MODULES for name, function in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
