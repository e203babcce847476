"""Every query against its SQL in DuckDB, values and types, on the smallest tables."""

import os

import duckdb
import pytest

from recordflow import catalogue

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "array<float>": "FLOAT[]", "array<string>": "VARCHAR[]", "array<bigint>": "BIGINT[]", "array<int>": "INTEGER[]"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(catalogue.oracle_sql()[name])
    names, kinds = [d[0] for d in found.description], {d[0]: str(d[1]) for d in found.description}
    assert sorted(names) == columns
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want
