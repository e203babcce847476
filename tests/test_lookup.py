"""The index: which blocks a lookup reads, and joins equal to plain ones."""

import random

from recordflow import lookup
from recordflow.operators import join


def rows(df):
    return sorted(map(str, df.collect()))


def test_lookup_reads_few_blocks(spark, tmp_path):
    table = spark.range(20_000).selectExpr("id * 3 as k", "id as v", "'h' as _hash")
    path = f"{tmp_path}/i"
    lookup.build(table, "k", path, block_rows=1000)
    m = lookup.manifest(spark, path)
    assert m.count() >= 20 and m.agg({"rows": "sum"}).first()[0] == 20_000 and m.agg({"rows": "max"}).first()[0] <= 1000
    for keys in ([30], [3, 59_997, 600]):
        assert len(lookup.blocks_for(spark, path, "k", keys)) <= 2 * len(keys)
        assert rows(lookup.lookup(spark, path, "k", keys)) == rows(table.where(f"k in ({', '.join(map(str, keys))})"))
    absent = [x * 3 + 1 for x in range(100)]  # not there: nearly always no block at all
    assert len(lookup.blocks_for(spark, path, "k", absent)) <= 8 and lookup.lookup(spark, path, "k", absent).count() == 0


def test_join_with_a_hot_key(spark, tmp_path):
    rng = random.Random(2)
    right = [(rng.choice(["hot"] * 5 + [f"k{i}" for i in range(40)] + [None]), i) for i in range(3000)]
    left = [(i, rng.choice(["hot", "k1", "k2", "none", None])) for i in range(40)]
    a, b = spark.createDataFrame(left, "i int, name string"), spark.createDataFrame(right, "name string, v int").repartition(5)
    path = f"{tmp_path}/i"
    lookup.build(b, "name", path, block_rows=100)
    assert lookup.manifest(spark, path).agg({"rows": "max"}).first()[0] <= 100
    for how in ("left", "inner", "semi", "anti"):
        assert rows(lookup.indexed_join(a, path, "name", "name", how)) == rows(join(a, b, on="name", how=how))


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "k long, v string")
    lookup.build(none, "k", f"{tmp_path}/i")
    assert lookup.lookup(spark, f"{tmp_path}/i", "k", [1]).count() == 0
    assert lookup.indexed_join(spark.range(3).toDF("x"), f"{tmp_path}/i", "x", "k").count() == 3
