"""Joins, edits, stores and streams on small tables."""

import pytest

from recordflow import docstore
from recordflow.operators import analyze, edit, head, inspect_schema, join, merge, range_join, tail
from recordflow.plans import apply
from recordflow.streaming import follow, run_available, tumbling_counts


def rows(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=repr)


def test_join(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, name string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "user long, name string")
    assert len(rows(join(a, b, left_key="id", right_key="user"))) == 4
    assert {r["name"] for r in rows(join(a, b, left_key="id", right_key="user", how="inner"))} == {"x", "y"}
    assert len(rows(join(a, b, left_key="id", right_key="user", how="inner", null_keys=True))) == 3
    assert join(a, b, left_key="id", right_key="user", suffix="_r").columns == ["id", "name", "name_r"]
    assert rows(join(a, b.selectExpr("cast(user as string) user", "name n"), left_key="id", right_key="user", how="inner")) == []
    with pytest.raises(ValueError):
        join(a, b)


def test_range_join(spark):
    a = spark.createDataFrame([("f", k) for k in range(20)], "file string, line long")
    b = spark.createDataFrame([("f", 3, 8, "g"), ("f", 15, 40, "h"), ("e", 0, 9, "i"), ("f", 9, 2, "j")], "source string, lo long, hi long, name string")
    want = rows(range_join(a, b, [("file", "source")], "line", "lo", "hi"))
    assert len(want) == 11


def test_edit(spark):
    df = spark.createDataFrame([(1, (2, "x"), ["t"])], "id long, p struct<a:long,b:string>, tags array<string>")
    out = rows(edit(df, ".p.c.d:=3", ".tags[2]=u", "-.p.b", '.tags+="v"', ".id+=5", ".new:=[1,2]", merge={"p": {"e": None}}))[0]
    assert out["p"] == {"a": 2, "e": None, "c": {"d": 3}} and out["tags"] == ["t", None, "u", "v"] and out["id"] == [1, 5] and out["new"] == [1, 2]
    assert rows(edit(df, "-.p.none", "-.gone")) == rows(df)
    with pytest.raises(ValueError):
        edit(df, "nonsense")


def test_head_tail_merge_profile(spark):
    df = spark.range(20).selectExpr("id", "id % 3 as k", "if(id % 4 = 0, null, id / 2) as v")
    assert [r.id for r in head(df, 3, ["id"]).collect()] == [0, 1, 2] and [r.id for r in tail(df, 2, ["id"]).collect()] == [18, 19]
    assert head(df, 0).count() == 0
    both = merge([("a", df, "A"), ("b", spark.range(2).selectExpr("id", "'z' as w"))])
    assert both.columns == ["_source", "_label", "id", "k", "v", "w"] and both.count() == 22
    r = {x["field"]: x for x in rows(analyze(df))}
    assert r["v"]["count"] == 15 and r["v"]["frequency"] == 75.0 and r["id"]["max"] == 19
    s = {x["field"]: x for x in rows(inspect_schema(df, 0))}
    assert s["v"]["nullable"] and not s["id"]["nullable"] and s["id"]["type"] == "number"
    assert len(rows(analyze(df.limit(0)))) == 3


def test_store(spark, tmp_path):
    store = docstore.insert(docstore.empty(spark, "name string, age long"), spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, age long"), ["name"])
    store = docstore.delete(docstore.update(store, 2, ".age:=5"), 3)
    got = {r.name: r for r in store.collect()}
    assert got["b"].age == 5 and got["b"]._meta.version == 2 and got["c"]._meta.deleted and docstore.visible(store).count() == 2
    assert docstore.stats(store).first().asDict() == {"total": 3, "active": 2, "deleted": 1, "max_id": 3}
    assert docstore.get(docstore.undelete(store, 3), 3).count() == 1 and docstore.purge(store).count() == 2 and docstore.check(store).count() == 0
    twice = store.unionByName(store.where("name = 'a'"))
    assert docstore.check(twice).count() == 1 and docstore.repair(twice)[0].count() == 3 and docstore.repair(twice)[1].count() == 1
    with pytest.raises(ValueError):
        docstore.update(store, 1, "._meta.id:=9")
    path = str(tmp_path / "s")
    docstore.write(store, path)
    docstore.write(docstore.purge(spark.read.parquet(path)), path)
    assert spark.read.parquet(path).count() == 2 and docstore.undo(spark, path).count() == 3
    assert docstore.query(store, "select(.age > 3) | .name").first().value == "b" and docstore.export_rows(store).columns[-1] == "data"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("".join(f'{{"ts": "2024-01-01 0{h}:0{k}:00", "kind": "a", "v": {h}}}\n' for h in range(4)))
    stream = follow(spark, str(tmp_path / "in"), "ts timestamp, kind string, v long", files_per_trigger=1)
    assert run_available(apply(stream, "select(.v > 1) | {v}"), "kept", str(tmp_path / "c1")).count() == 6
    counted = run_available(tumbling_counts(stream, "ts", "1 hour", ["kind"], "2 hours"), "counted", str(tmp_path / "c2"), "complete")
    assert [r["count"] for r in counted.orderBy("start").collect()] == [3, 3, 3, 3]
