"""Source facts, and the command line's parts."""

import pytest
from pyspark.sql import Observation

from recordflow.__main__ import main, parser, run
from recordflow.coverage import call_counts
from recordflow.operators import join
from recordflow.sources.code import dead, load_code, with_coverage

TEXT = '''
class A:
    def used(self, x, *rest, key=1):
        return helper(x)

    def unused(self):
        pass

def helper(x):
    return A().used(x)
'''


def test_facts(spark, tmp_path):
    (tmp_path / "m.py").write_text(TEXT)
    (tmp_path / "broken.py").write_text("def (")
    code = load_code(spark, str(tmp_path)).cache()
    got = {(r.kind, r.name): r for r in code.collect()}
    assert got["method", "A.used"].params == ["self", "x", "rest", "key"] and ("class", "A") in got and ("file", "broken.py") in got
    assert [r.name for r in dead(code).collect()] == ["A.unused"]
    assert {r.callee for r in call_counts(code.where("kind = 'call'")).collect()} >= {"helper"}
    lines = spark.createDataFrame([("line", "m.py", 3, 1), ("line", "m.py", 4, 0), ("line", "m.py", 10, 2)], "kind string, file string, line long, hits long")
    assert {r.name: r.share for r in with_coverage(code, lines, least=0.1).collect()} == {"A.used": 0.5, "helper": 1.0}


def test_command_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1, "k": "a"}\n{"x": 2, "k": "b"}\n{"x": 3, "k": "a"}\n')
    at = f"{tmp_path}/a.jsonl"
    go = lambda *argv: [r.asDict() for r in run(parser().parse_args(list(argv)), spark).collect()]
    assert go("filter", at, "select(.x > 1) | .x") == [{"value": 2}, {"value": 3}]
    assert go("filter", "-s", at, "{n: length}") == [{"n": 3}]
    assert go("tail", at, "-n", "1", "--order", "x") == [{"k": "a", "x": 3}]
    assert len(go("merge", f"{at}:label=L", at)) == 6 and len(go("join", at, at, "--on", "k", "--inner")) == 5
    assert go("edit", at, ".x:=0", "--delete", ".k")[0] == {"x": 0}
    assert {r["field"] for r in go("analyze", at)} == {"x", "k"} == {r["field"] for r in go("inspect", at)}


def test_raw_output_exit_status_and_skipped_keys(spark, tmp_path, capsys):
    (tmp_path / "a.jsonl").write_text('{"k": "a", "on": true}\n{"k": "b\\"", "on": false}\n{"on": true}\n')
    at = f"{tmp_path}/a.jsonl"
    assert main(["filter", at, ".k", "-r"]) == 0
    assert capsys.readouterr().out.splitlines()[:2] == ["a", 'b"']
    assert main(["filter", at, ".on", "-e"]) == 0 and main(["filter", at, 'select(.k == "z")', "-e"]) == 1 and main(["filter", at, "select(.k) | .on", "-e"]) == 1
    capsys.readouterr()
    assert main(["join", at, at, "--on", "k"]) == 0
    assert "1 records of the left side lack the key" in capsys.readouterr().err
    with pytest.raises(Exception, match="lacks k"):
        main(["join", at, at, "--on", "k", "--strict"])


def test_skipped_keys_are_observed(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string")
    seen = Observation(), Observation()
    assert join(a, a.where("k = 1"), on="k", skipped=seen).count() == 2
    assert seen[0].get == {"missing_keys": 1, "records": 2} and seen[1].get == {"missing_keys": 0, "records": 1}
