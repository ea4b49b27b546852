"""Every query with a SQL twin gives the same rows on both engines."""

import pytest

import __spark_entry__ as entry
from tools.check import canon, duck

SQL = entry.oracle_sql()
RUN = entry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, sf_dir, name):
    df = RUN[name](spark, sf_dir)
    cur = con.execute(SQL[name])
    wanted = canon([d[0] for d in cur.description], cur.fetchall())
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == wanted


def test_every_check_belongs_to_a_query():
    assert set(SQL) <= set(RUN)


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"station", "flight_category", "hour", "n", "active", "active_rate"}
    assert df.count() > 0
