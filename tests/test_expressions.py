"""The parser, and values of single expressions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordflow.expr import ExpressionError, parse
from recordflow.expr import tree as T
from recordflow.plans import apply, slurp


def test_precedence_and_quotes():
    assert parse(".a or .b and .c") == T.Binary("or", T.Field(T.Identity(), "a"), T.Binary("and", T.Field(T.Identity(), "b"), T.Field(T.Identity(), "c")))
    assert parse("10 - 3 - 2") == T.Binary("-", T.Binary("-", T.Literal(10), T.Literal(3)), T.Literal(2))
    assert parse('"a | b, and c"') == T.Literal("a | b, and c")
    assert parse(".items[].name") == T.Field(T.Iterate(T.Field(T.Identity(), "items")), "name")


@pytest.mark.parametrize("text", ["$x", "reduce .[] as $x (0; . + $x)", "def f: .;", "..", ".a |", "{a:", 'split("")', "split(.a)", "if . then 1 end", ".a ! .b", "limit(3; .[])", "(" * 200 + "." + ")" * 200])
def test_refused(text):
    with pytest.raises(ExpressionError):
        parse(text)


@given(st.text(max_size=20))
@settings(max_examples=200, deadline=None)
def test_any_text_parses_or_says_why(text):
    try:
        parse(text)
    except ExpressionError:
        pass


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(1, "Hello big-World", 2.5, [3, 1, 2], (1, None), True)], "id long, name string, v double, a array<long>, m struct<x:long,y:long>, b boolean")


@pytest.mark.parametrize(
    "text,want",
    [
        (".a[-1]", [2]), (".a[9]", []), (".a[1:]", [[1, 2]]), (".a[2:1]", [[]]), (".a[]", [3, 1, 2]), (".a | map(. * 2) | add", [12]), ("[.a[] | select(. > 1)]", [[3, 2]]),
        (".missing", []), ('.missing // "d"', ["d"]), ("select(.missing != 1) | .id", []), ("select(not (.missing == 1)) | .id", [1]), ('select(.id == "1") | .id', []), ('select(.id != "1") | .id', [1]),
        (".id / 0", []), ("-7 % 3", [2]), ("7 % -3", [-2]), (".v | round", [3]), (".v | floor", [2]), ("-2.5 | round", [-3]), ("0 | ln", []), (".name | length", [15]), (".name | snakecase", ["hello_big_world"]),
        (".name | camelcase", ["helloBigWorld"]), (".name | slugify", ["hello-big-world"]), (".name | titlecase", ["Hello Big-World"]), (".name | words", [["Hello", "big-World"]]), ('.name | test("^Hello")', [True]),
        (".a | sort", [[1, 2, 3]]), (".a | max_by(.)", [3]), (".a | group_by(.)", [[[1], [2], [3]]]), (".m | keys", [["x", "y"]]), ('"12" | tonumber', [12.0]), ('" 12" | tonumber', []), ("true | tostring", ["true"]),
        ("3.0 | tostring", ["3"]), (".a | type", ["array"]), (".name | floor", []), ("if .b then 1 else 2 end", [1]), ("if .v > 9 then 1 elif .v > 2 then 2 else 3 end", [2]),
        ('"2020-01-01T00:00:00Z" | delta > 0', [True]), ("(xid | xid_time) - epoch", [0]), ("uuid | length", [36]), ('"" | empty', [True]), ("9223372036854775807 | incr", []),
    ],
)
def test_values(one, text, want):
    assert [r[0] for r in apply(one, text).collect()] == want


def test_ago(spark):
    from pyspark.sql import functions as F

    from recordflow.functions.registry import ago_text

    rows = spark.createDataFrame([(s,) for s in (1, 59, 60, 3600, 3661, 86400, 90000, 86400 * 31, 86400 * 800, -120)], "s long").select(ago_text(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["1 second ago", "59 seconds ago", "1 minute ago", "1 hour ago", "1 hour, 1 minute ago", "1 day ago", "1 day, 1 hour ago", "1 month, 1 day ago", "2 years, 2 months ago", "2 minutes from now"]


def test_plans(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 as k", "id * 2 as v", "'x' as pad").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = apply(df, "select(.id > 990) | {v}")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,990)" in plan and "pad" not in plan
    assert "TakeOrderedAndProject" in slurp(df, "sort_by(.v) | reverse | .[0:3] | .[]")._jdf.queryExecution().executedPlan().toString()
    assert slurp(df, "group_by(.k) | map({k: .[0] | .k, n: length}) | .[]").count() == 7
