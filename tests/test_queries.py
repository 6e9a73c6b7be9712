"""Each registered query against its SQL, on the smallest tables."""

import datetime

import duckdb
import pytest

from tidemill.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return "NULL" if v is None else f"{type(v).__name__}:{v}"


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(map(plain, r)) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    got = rows(queries.QUERIES[name](spark, SF).toArrow())
    want = rows(duck.sql(queries.ORACLES[name]).to_arrow_table())
    assert got == want


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)
