"""Queries with oracles on the smallest tables, one by one."""

import pytest

from pathloom.plans import catalog
from tests.oracle import check

#: Many small jobs each; the driver's comparison covers them at sf0.01.
SLOW = {"hierarchy_search", "lazy_hierarchy", "hierarchy_labels", "forward_labels", "forward_closure_labels", "apex_search", "corner_hierarchy_search"}


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_query_equals_oracle(spark, name):
    check(spark, catalog.queries()[name], catalog.oracle_sql()[name])


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_imports_without_the_optional_package():
    import importlib.abc
    import sys

    class Gone(importlib.abc.MetaPathFinder):
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("pathloom.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    saved = {k: sys.modules.pop(k) for k in list(sys.modules) if k in ("corpus_pipeline", "__spark_entry__") or k.startswith("pathloom.llm")}
    sys.meta_path.insert(0, gone := Gone())
    try:
        import __spark_entry__

        assert not any(k.startswith("op") or k == "pipeline" for k in __spark_entry__.queries())
    finally:
        sys.meta_path.remove(gone)
        sys.modules.pop("__spark_entry__", None)
        sys.modules.update(saved)
