"""Every query of the library against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from rillwork.plans import catalog

from .compare import connect, rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    ours = catalog.QUERIES[name](spark, sf_dir).toPandas()
    theirs = duck.execute(catalog.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
