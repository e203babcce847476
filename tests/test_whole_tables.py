"""Queries of two names over whole tables, larger than those of the other tests."""

import os

import duckdb
import pytest

from recordflow import catalogue

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n.endswith("_all")])
def test_whole(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = catalogue.queries()[name](spark, DATA)
    found = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == want
    assert len(want) == len(catalogue.queries()[name.removesuffix("_all")](spark, DATA).collect()) or name.startswith("join_right")
