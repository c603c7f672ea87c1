import duckdb
import pytest

from weir import workload

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t, _ in workload.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(workload.queries()))
def test_against_sql(spark, con, name):
    df = workload.queries()[name](spark, SF)
    sql = workload.oracle_sql().get(name)
    rows = df.collect()
    if sql is None:
        assert rows
        return
    rel = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    order = [rel.columns.index(c) for c in cols]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in rows), key=key) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
