"""Snapshots, files that an update leaves alone, two writers, and what changed between tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from recordflow import versions


@pytest.fixture
def store(spark, tmp_path):
    s = versions.Store(spark, f"{tmp_path}/s", file_rows=50)
    s.insert(spark.range(400).selectExpr("id as n", "concat('x', id) as t"), ["n"])
    return s


def files(store, version):
    return {f["file"] for f in store._snapshot(version)["files"]}


def test_an_update_replaces_only_files_with_the_id(store):
    assert store.versions() == [1] and len(files(store, 1)) >= 7
    assert store.update(123, ".t=new") == 2
    assert len(files(store, 1) - files(store, 2)) == 1 and len(files(store, 2) - files(store, 1)) == 1
    assert store.read().where("_meta.id = 123").select("t", "_meta.version").first() == ("new", 2)
    assert store.read(1).where("_meta.id = 123").first().t == "x122" and store.read().count() == 400
    assert store.delete(5) == 3 and store.read().where("_meta.deleted").count() == 1 and store.read(2).where("_meta.deleted").count() == 0
    assert store.undo() == 4 and store.read().where("_meta.deleted").count() == 0
    assert store.change([999_999], lambda rows: rows) == 4  # no file, no version
    assert [h["what"] for h in store.history()] == ["append", "update", "delete", "undo"] and {h["rows"] for h in store.history()} == {400}


def test_inserts_go_on(spark, store):
    store.insert(spark.createDataFrame([(7000, "late")], "n long, t string"))
    assert store.read().agg(F.max("_meta.id"), F.count_distinct("_meta.id")).first() == (401, 401)


def test_of_two_writers_one_wins(store):
    seen = store.versions()[-1]
    store.update(1, ".t=first", at=seen)
    with pytest.raises(versions.Conflict):
        store.update(300, ".t=second", at=seen)
    assert store.versions() == [1, 2] and store.read().where("t = 'second'").count() == 0
    assert not [n for n in os.listdir(f"{store.path}/log") if n.endswith(".new")]


@pytest.mark.parametrize("buckets", [3, 4096])
def test_changes(spark, buckets):
    rng = random.Random(1)
    old = {i: (rng.choice([None, 1, 2]), f"t{i % 5}") for i in range(500)}
    new = {i: v for i, v in old.items() if i % 50}
    for i in range(7, 500, 60):
        new[i] = (old[i][0], "other") if i % 2 else (9, "other")
    new |= {1000 + i: (i, "n") for i in range(5)}
    a, b = (spark.createDataFrame([(k, *v, k) for k, v in d.items()], f"k int, v int, t string, {extra} int").repartition(3) for d, extra in ((old, "only_old"), (new, "_b")))
    got = {r.k: (r.change, r.columns) for r in versions.changes(a, b, ["k"], buckets).collect()}
    want = {k: ("removed", None) for k in old if k not in new} | {k: ("added", None) for k in new if k not in old}
    want |= {k: ("changed", [c for c, x, y in zip(("v", "t"), old[k], new[k], strict=True) if x != y]) for k in old if k in new and old[k] != new[k]}
    assert got == want and len(want) > 20
    assert versions.changes(a, a, ["k"], buckets).count() == 0


def test_changes_between_versions(store):
    store.update(8, ".t=eight")
    r = versions.changes(store.read(1), store.read(2), ["n"]).collect()
    assert [(x.n, x.change, x.columns) for x in r] == [(7, "changed", ["t", "_meta"])]
