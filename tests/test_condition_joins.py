"""As-of, interval, theta and overlap joins against loops, with small ranges and cells so that keys and intervals are split."""

import random

import pytest
from pyspark.sql.functions import spark_partition_id

from recordflow.operators import asof_join, joins, overlap_join, range_join, theta_join


@pytest.fixture(params=[(15, 9), (10_000, 10_000)])
def small(request, monkeypatch):
    monkeypatch.setattr(joins, "ASOF_ROWS", request.param[0])
    monkeypatch.setattr(joins, "CELL_ROWS", request.param[1])


def table(spark, seed, n, columns):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 6 + ["cold", "other", None])
    rows = [(i, key(), rng.choice([None, *range(0, 60)]), rng.randint(0, 99)) for i in range(n)]
    return rows, spark.createDataFrame(rows, columns).repartition(4)


def near(left, right, key, forward, tolerance):
    out = {}
    for i, k, t, _ in left:
        ok = [(rt, j) for j, rk, rt, _ in right if t is not None and rt is not None and (not key or k is not None and k == rk) and (rt >= t if forward else rt <= t)]
        best = None if not ok else min(x for x, _ in ok) if forward else max(x for x, _ in ok)
        if best is not None and tolerance is not None and abs(best - t) > tolerance:
            best = None
        out[i] = (best, {j for rt, j in ok if rt == best})
    return out


@pytest.mark.parametrize(("direction", "tolerance", "keyed"), [("backward", None, True), ("forward", None, True), ("backward", 3, True), ("forward", 1, False), ("backward", None, False)])
def test_asof(spark, small, direction, tolerance, keyed):
    left, a = table(spark, 1, 150, "id int, k string, t int, range int")
    right, b = table(spark, 2, 40, "j int, k string, t int, m int")
    keys = [("k", "k")] if keyed else []
    want = near(left, right, keyed, direction == "forward", tolerance)
    got = asof_join(a, b, "t", "t", keys, direction, tolerance)
    assert got.columns == ["id", "k", "t", "range", "j", "k_right", "t_right", "m"]
    rows = got.collect()
    assert sorted(r.id for r in rows) == sorted(want)
    for r in rows:
        best, who = want[r.id]
        assert r.t_right == best and (r.j in who if best is not None else r.j is None and r.m is None)
    inner = asof_join(a, b, "t", "t", keys, direction, tolerance, how="inner").collect()
    assert {r.id for r in inner} == {i for i, (best, _) in want.items() if best is not None}


def test_asof_of_nothing(spark):
    a = spark.createDataFrame([(1, 5), (2, None)], "id int, t int")
    none = a.limit(0).withColumnRenamed("id", "j")
    assert sorted(tuple(r) for r in asof_join(a, none, "t", "t").collect()) == [(1, 5, None, None), (2, None, None, None)]
    assert asof_join(none, a, "t", "t").count() == 0
    with pytest.raises(ValueError):
        asof_join(a, a, "t", "t", direction="sideways")


def test_intervals(spark, small):
    rng = random.Random(3)
    points = [(i, rng.choice(["x", "x", "y", None]), rng.choice([None, *range(0, 100)])) for i in range(120)]
    spans = [(i, rng.choice(["x", "y", None]), s, rng.choice([None, s, s + 2, s + 200, s - 1])) for i in range(60) for s in [rng.randint(-5, 99)]]
    a, b = spark.createDataFrame(points, "i int, k string, _node int"), spark.createDataFrame(spans, "j int, kk string, lo int, hi int")
    for ends, test in (("both", lambda v, lo, hi: lo <= v <= hi), ("start", lambda v, lo, hi: lo <= v < hi), ("end", lambda v, lo, hi: lo < v <= hi), ("neither", lambda v, lo, hi: lo < v < hi)):
        for keys in ([("k", "kk")], []):
            want = sorted((i, j) for i, k, v in points for j, kk, lo, hi in spans if v is not None and hi is not None and lo <= hi and (not keys or k is not None and k == kk) and test(v, lo, hi))
            got = range_join(a, b, keys, "_node", "lo", "hi", ends)
            assert got.columns == ["i", "k", "_node", "j", "kk", "lo", "hi"] and sorted((r.i, r.j) for r in got.collect()) == want
    for op, test in (("<", lambda v, x: v < x), ("<=", lambda v, x: v <= x), (">", lambda v, x: v > x), (">=", lambda v, x: v >= x)):
        want = sorted((i, j) for i, k, v in points for j, kk, lo, _ in spans if v is not None and k is not None and k == kk and test(v, lo))
        assert sorted((r.i, r.j) for r in theta_join(a, b, "_node", op, "lo", [("k", "kk")]).collect()) == want
    want = sorted((i, j) for i, k, lo, hi in spans for j, kk, lo2, hi2 in spans if None not in (hi, hi2, k) and k == kk and lo <= hi and lo2 <= hi2 and lo <= hi2 and lo2 <= hi)
    got = overlap_join(b, b, ("lo", "hi"), ("lo", "hi"), [("kk", "kk")])
    assert sorted((r[0], r[4]) for r in got.collect()) == want


def test_text_and_empty(spark, small):
    words = spark.createDataFrame([(w,) for w in ("ant", "bee", "cow", "dog", "eel")], "w string")
    spans = spark.createDataFrame([("b", "d"), ("a", "z")], "lo string, hi string")
    assert sorted(tuple(r) for r in range_join(words, spans, [], "w", "lo", "hi").select("w", "lo").collect()) == [("ant", "a"), ("bee", "a"), ("bee", "b"), ("cow", "a"), ("cow", "b"), ("dog", "a"), ("eel", "a")]
    assert range_join(words, spans.limit(0), [], "w", "lo", "hi").count() == 0 and range_join(words.limit(0), spans, [], "w", "lo", "hi").count() == 0


def test_copies_of_an_interval_are_bounded(spark):
    """An interval stands in two nodes of each level of the tree at most, and in every cell once."""
    from pyspark.sql import functions as F

    for leaves in (1, 2, 64):
        rows = [(a, b) for a in range(leaves) for b in range(a, leaves)][:: 1 if leaves < 64 else 37]
        for r in spark.createDataFrame(rows, "a int, b int").select("a", "b", joins._covers(F.col("a"), F.col("b"), leaves).alias("nodes")).collect():
            under = [leaf for leaf in range(leaves) for h in range(leaves.bit_length()) if (leaf + leaves) >> h in r.nodes]
            assert under == list(range(r.a, r.b + 1)) and len(r.nodes) <= 2 * leaves.bit_length()


def test_theta_deals_pairs_to_all_tasks(spark):
    """Small sides with many pairs are not broadcast, which would leave the pairs to the tasks that read a small file; a value is not copied."""
    a = spark.range(3000).selectExpr("id as i", "id % 2 as k", "id as v").coalesce(1)
    got = theta_join(a, a.toDF("j", "kk", "w"), "v", "<", "w", [("k", "kk")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert got.count() == 2 * (1500 * 1499 // 2)
    held = got.select("i", "j", spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(held) > 1


def test_intervals_of_other_kinds(spark, monkeypatch):
    """Keys of different kinds, times without a zone, missing numbers and wide keys against a loop."""
    monkeypatch.setattr(joins, "CELL_ROWS", 3)
    rng = random.Random(8)
    points = [(i, f"0{rng.randint(0, 3)}", rng.randint(0, 3), rng.choice([None, float("nan"), -1.5, 0.0, -0.0, *map(float, range(30))]), rng.randint(0, 10**6)) for i in range(150)]
    spans = [(i, rng.randint(0, 3), s, s + rng.randint(0, 9), t, t + rng.randint(0, 10**5)) for i in range(60) for s, t in [(float(rng.randint(-3, 30)), rng.randint(0, 10**6))]]
    at = "timestamp_ntz'1969-12-31 23:59:59.3' + make_dt_interval(0, 0, 0, {} / 1000000)"
    a = spark.createDataFrame(points, "i int, k string, n int, v double, t long").selectExpr("i", "k", "n", "v", "t", f"{at.format('t')} as ts")
    b = spark.createDataFrame(spans, "j int, kk long, lo double, hi double, t0 long, t1 long").selectExpr("*", f"{at.format('t0')} as s0", f"{at.format('t1')} as s1")
    for key in ("k", "n"):
        want = sorted((i, j) for i, k, n, v, _ in points for j, kk, lo, hi, *_ in spans if int(k if key == "k" else n) == kk and v is not None and lo <= v <= hi)
        assert sorted((r.i, r.j) for r in range_join(a, b, [(key, "kk")], "v", "lo", "hi").collect()) == want
        want = sorted((i, j) for i, k, n, _, t in points for j, kk, _, _, t0, t1 in spans if int(k if key == "k" else n) == kk and t0 <= t <= t1)
        assert sorted((r.i, r.j) for r in range_join(a, b, [(key, "kk")], "ts", "s0", "s1").collect()) == want
