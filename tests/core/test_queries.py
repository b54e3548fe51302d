import glob
import os

import duckdb
import pytest

from murmuration.plans import queries, sql

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, duck, name):
    want = duck.execute(sql.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    key = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert key(got) == key(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(sql.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["seg_id", "degree", "strength"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
