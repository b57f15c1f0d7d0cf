"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from strandlake import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(table) -> list:
    names = sorted(table.column_names)
    data = table.select(names).to_pylist()
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 4) + 0.0 if isinstance(v, float) else v
    return sorted(([clean(r[n]) for n in names] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    ours, theirs = queries.queries()[name](spark, SF).toArrow(), duck.sql(SQL[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows(ours) == rows(theirs)
