"""Every query of the library against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from memspark import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def as_text(row):
    return str(tuple(v + 0.0 if isinstance(v, float) else v for v in row))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    rows = sorted(as_text([r[n] for n in order]) for r in df.collect())
    if name in queries.ORACLE_SQL:
        r = con.sql(queries.ORACLE_SQL[name])
        assert sorted(r.columns) == order
        at = [r.columns.index(n) for n in order]
        assert rows == sorted(as_text([x[i] for i in at]) for x in r.fetchall())
    else:
        assert rows
