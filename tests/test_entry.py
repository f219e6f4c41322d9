"""The registered queries run on the smallest tables and give what their SQL gives."""

import os

import duckdb
import pytest

import __spark_entry__ as e
from sieveworks.plans import delivered, harness

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(frame):
    return sorted((tuple(sorted((k, str(v) if v is not None else "") for k, v in r.items())) for r in frame))


@pytest.mark.parametrize("name", sorted(harness.QUERIES | delivered.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    got = e.queries()[name](spark, SF)
    found = duck.execute(e.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(r.asDict() for r in got.collect()) == rows(dict(zip(columns, r)) for r in found.fetchall())


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
