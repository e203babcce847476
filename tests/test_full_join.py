"""Rows of either side only."""

from recordflow.operators import join


def test_full_join_indicator(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    b = spark.createDataFrame([(2, "x"), (3, "y")], "k long, v string")
    got = join(a, b, on="k", how="full", indicator="side").collect()
    assert sorted(tuple(r) for r in got) == sorted([(1, None, "left_only"), (2, "x", "both"), (3, "y", "right_only")], key=str)
