"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from trackloom.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(row):
    return repr(tuple(round(float(v), 5) + 0.0 if v.__class__.__name__ in ("float", "Decimal") else v for v in row))


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{tiny}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, duck, name):
    found = QUERIES[name](spark, tiny)
    columns = sorted(found.columns)
    rows = sorted(plain(r) for r in found.select(columns).collect())
    if name in SQL:
        want = sorted(plain(r) for r in duck.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall())
        assert rows == want
