"""Every registered query with SQL against that SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from sluice.plans import catalog
from tools.compare import duck, rows_of

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.ORACLES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    df = queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows_of(cols, cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 2


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
