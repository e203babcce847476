"""Slurped expressions against lists in Python, and what their plans hold."""

import pytest

from recordflow.expr import ExpressionError
from recordflow.plans import slurp

ROWS = [(i, i * 7 % 5, i * 13 % 11, f"n{i % 4}", [i, i + 1][: i % 3]) for i in range(12)]
GROUPS = [[r for r in ROWS if r[1] == k] for k in range(5)]
BY_V = sorted(ROWS, key=lambda r: r[2])

CASES = {
    "last | .i": [11],
    "reverse | map(.i)": list(range(11, -1, -1)),
    "reverse | .[0:2] | map(.i)": [11, 10],
    "map(.v) | sort | .[0:3]": [0, 0, 1],
    "map(.v) | sort | reverse | .[2]": [sorted((r[2] for r in ROWS), reverse=True)[2]],
    "map(.s) | unique": ["n0", "n1", "n2", "n3"],
    "map(.s) | unique | length": [4],
    "map({x: .v}) | unique | length": [11],
    "[.[] | .k] | length": [12],
    "[.[] | select(.v > 4) | .i] | length": [sum(r[2] > 4 for r in ROWS)],
    "group_by(.k) | map(sort_by(.v) | .[0]) | map(.i)": [min(g, key=lambda r: r[2])[0] for g in GROUPS],
    "group_by(.k) | map(sort_by(.v) | reverse | .[0:2] | map(.v))": [sorted((r[2] for r in g), reverse=True)[:2] for g in GROUPS],
    "group_by(.k) | map(map(select(.v > 8)) | length)": [sum(r[2] > 8 for r in g) for g in GROUPS],
    "group_by(.k) | map(map(select(.v > 8)) | map(.i))": [[r[0] for r in g if r[2] > 8] for g in GROUPS],
    "group_by(.k) | map(select(length > 2)) | map(.[0] | .k)": [k for k, g in enumerate(GROUPS) if len(g) > 2],
    "group_by(.k) | map(.[2] | .i)": [g[2][0] for g in GROUPS if len(g) > 2],
    "group_by(.k) | map(.[1:] | map(.i))": [[r[0] for r in g[1:]] for g in GROUPS],
    "group_by(.k) | map(.[2:3] | length)": [int(len(g) > 2) for g in GROUPS],
    "group_by(.k) | map(map({k: .v}) | .[0] | .k)": [g[0][2] for g in GROUPS],
    "group_by(.k) | sort_by(length) | reverse | .[0:1] | map(length)": [3],
    "group_by(.k) | length": [5],
    "group_by(.k) | .[1] | map(.i)": [r[0] for r in GROUPS[1]],
    "group_by(.k) | map([.[] | .a[]] | length)": [sum(len(r[4]) for r in g) for g in GROUPS],
    "group_by(.k) | map(max_by(.v) | .i)": [max(g, key=lambda r: r[2])[0] for g in GROUPS],
    "unique_by(.s) | map(.i)": [0, 1, 2, 3],
    "map(.a[]) | add": [sum(x for r in ROWS for x in r[4])],
    "map(.a) | add | length": [sum(len(r[4]) for r in ROWS)],
    "map(.s) | add": ["".join(r[3] for r in ROWS)],
    "(map(.v) | add) / length": [sum(r[2] for r in ROWS) / 12],
    'if length > 3 then "many" else "few" end': ["many"],
    "[length, (map(.v) | add)]": [[12, sum(r[2] for r in ROWS)]],
    ".[2:4] | map(.i)": [2, 3],
    ".[-2:] | map(.i)": [10, 11],
    ".[0:-9] | map(.i)": [0, 1, 2],
    ".[] | .a[] | select(. > 9)": [x for r in ROWS for x in r[4] if x > 9],
    "sort_by(.v) | .[] | .i": [r[0] for r in BY_V],
    "max_by(.v) | .i": [max(ROWS, key=lambda r: r[2])[0]],
    "map(select(.v > 100)) | length": [0],
}
#: Groups come in any order.
UNORDERED = ("group_by", ".[] | .a", "unique_by")


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "i int, k int, v int, s string, a array<int>").repartition(3)


@pytest.mark.parametrize("expression", CASES)
def test_forms(df, expression):
    got = [r[0] for r in slurp(df, expression, ["i"]).collect()]
    want = CASES[expression]
    assert sorted(got) == sorted(want) if expression.startswith(UNORDERED) else got == want


def test_objects(df):
    (r,) = slurp(df, "{n: length, top: (sort_by(.v) | reverse | .[0:3] | map(.i)), first: (first | .s), sum: ((map(.v) | add) + 1)}", ["i"]).collect()
    assert tuple(r) == (12, [x[0] for x in sorted(ROWS, key=lambda r: (r[2], r[0]), reverse=True)[:3]], "n0", sum(x[2] for x in ROWS) + 1)
    rows = slurp(df, "group_by(.k) | map(group_by(.s) | map({k: .[0] | .k, s: .[0] | .s, ids: map(.i)})) | flatten", ["i"]).collect()
    assert {(r.k, r.s): r.ids for r in rows} == {(k, s): [r[0] for r in ROWS if (r[1], r[3]) == (k, s)] for k, s in {(r[1], r[3]) for r in ROWS}}


def test_order_of_reading(spark, tmp_path):
    path = str(tmp_path / "t.json")
    with open(path, "w") as f:
        f.writelines(f'{{"x": {i * 7 % 10}, "_key": {i}}}\n' for i in range(10))
    rows = spark.read.json(path)
    assert [r[0] for r in slurp(rows, "map(._key) | last").collect()] == [9]
    assert [r[0] for r in slurp(rows, "reverse | map(.x) | .[0:2]").collect()] == [3, 6]
    # a field of that name is a group's own value and not lost
    assert {tuple(r) for r in slurp(rows, "group_by(.x) | map({_key: .[0] | ._key, n: length}) | .[]").collect()} == {(i, 1) for i in range(10)}


def test_nothing(spark):
    none = spark.createDataFrame([], "k int, v int")
    assert [tuple(r) for r in slurp(none, "{n: length, m: (map(.v) | max)}").collect()] == [(0, None)]
    for e in ("last", "map(.v) | sort", "group_by(.k) | map(length)", "map(.v) | max", "unique_by(.k)", "group_by(.k) | map(sort_by(.v) | .[0])"):
        assert slurp(none, e).count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None), (1, 2)], "k int, v int")
    assert [tuple(r) for r in slurp(nulls, "group_by(.k) | map({k: .[0] | .k, n: length, v: (map(.v) | length)}) | .[]").collect()] == [(1, 2, 1)]


def test_plans(df):
    plan = lambda e: slurp(df, e, ["i"])._jdf.queryExecution().executedPlan().toString()
    grouped = plan("group_by(.s) | map({s: .[0] | .s, n: length, v: (map(.v) | add)}) | .[]")
    assert "HashAggregate" in grouped and "SortAggregate" not in grouped and "first(" not in grouped
    best = plan("group_by(.k) | map(sort_by(.v) | .[0:2]) | flatten | .[] | {i}")
    assert "WindowGroupLimit" in best and "collect_list" not in best  # a task sends two rows of a group
    for e in ("map(.v) | sort | .[0:3]", "reverse | .[0:2]", ".[-2:]"):
        assert "TakeOrderedAndProject" in plan(e) and "collect_list" not in plan(e)


def test_refused(df):
    for e in (".k", ".[2:-1]"):
        with pytest.raises(ExpressionError):
            slurp(df, e, ["i"])
