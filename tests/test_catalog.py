"""Every registered query against its SQL on the same tables."""

import pytest

from siltstone.plans import catalog, more, store  # noqa: F401

from .conftest import rows_of


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, data, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, data).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "siltstone"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
