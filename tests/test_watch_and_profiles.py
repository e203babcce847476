"""A folder's changes as a stream, and the schema of a profile's records."""

import json

from recordflow.profiles import Profiles
from recordflow.sources import inspect_profile
from recordflow.streaming import register_watch


def test_changes_of_a_folder(spark, tmp_path):
    register_watch(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("1")
    (folder / "b.tmp").write_text("1")
    stream = spark.readStream.format("watch").option("exclude", "*.tmp").load(str(folder))
    q = stream.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
        (folder / "sub").mkdir()
        (folder / "sub" / "c.txt").write_text("22")
        (folder / "a.txt").write_text("333")
        q.processAllAvailable()
        (folder / "a.txt").unlink()
        q.processAllAvailable()
    finally:
        q.stop()
    got = [tuple(r) for r in spark.table("changes").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("a.txt", "created", 1), ("a.txt", "modified", 3), ("sub/c.txt", "created", 2), ("a.txt", "deleted", None)]))


def test_schema_of_a_profile(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "x.jsonl").write_text('{"level": "info", "n": 1}\n{"level": "error", "n": null}\n')
    (tmp_path / "logs" / "all.json").write_text(json.dumps({"pattern": f"{tmp_path}/x.jsonl", "inject_meta": False}))
    got = {r.field: r for r in inspect_profile(spark, Profiles(str(tmp_path)), "logs/all").collect()}
    assert got["n"].type == "number" and got["n"].nullable and got["level"].profile == "logs/all" and set(got["level"].samples) == {"info", "error"}
