"""Addresses, readers, profiles and writers, on small files made here."""

import gzip
import json

import pytest

from recordflow.address import parse_address
from recordflow.profiles import Profiles, sql_parameters, substitute
from recordflow.sinks import save, table_text, to_json
from recordflow.sources import load
from recordflow.sources.load import shell, sniff


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_addresses():
    a = parse_address("data/x.csv.gz?delimiter=tab")
    assert (a.kind, a.format, a.compression, a.params) == ("file", "csv", "gzip", {"delimiter": "tab"})
    assert parse_address("x.tsv~json").format == "json" and parse_address("@ns/q?p=1").path == "ns/q"
    assert parse_address("d/**/*.jsonl").kind == "glob" and parse_address("-").format == "jsonl"
    assert parse_address("https://h/p?a=b").path == "https://h/p?a=b"
    for bad in ("", "@ns"):
        with pytest.raises(ValueError):
            parse_address(bad)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,n\n"x, ""y""",1\nz\n\n')
    assert rows(load(spark, f"{tmp_path}/a.csv")) == [{"name": 'x, "y"', "n": "1"}, {"name": "z", "n": None}]
    (tmp_path / "b.csv").write_text("a;b\n1;2\n3;4\n5;6\n")
    assert load(spark, f"{tmp_path}/b.csv").columns == ["a", "b"]
    assert load(spark, f"{tmp_path}/b.csv", header="false").columns == ["col0", "col1"]
    assert sniff(["a,b"]) == "," and sniff(["a|b|c"] * 4) == "|"


def test_json_and_gzip(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2, "y": [1]}]')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"x": 1}\n{"x": 3}\n')
    assert [r["x"] for r in rows(load(spark, f"{tmp_path}/a.json"))] == [1, 2]
    out = load(spark, f"{tmp_path}/b.jsonl.gz", lineage=True)
    assert out.columns[:5] == ["_path", "_dir", "_filename", "_basename", "_ext"] and out.count() == 2
    assert load(spark, f"{tmp_path}/**/*.jsonl.gz").count() == 2


def test_documents(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("- {n: x, ok: yes, d: 2020-01-02}\n- {n: y, ok: no}\n")
    assert rows(load(spark, f"{tmp_path}/a.yaml")) == [{"n": "x", "ok": True, "d": "2020-01-02"}, {"n": "y", "ok": False, "d": None}]
    (tmp_path / "a.toml").write_text('a = 1\n[t]\nb = [1, 2]\nc = "x"\n')
    assert rows(load(spark, f"{tmp_path}/a.toml"))[0]["a"] == 1
    (tmp_path / "a.md").write_text("---\ntitle: T\n---\n# H\n\ntext\n\n```py\nx=1\n```\n")
    assert [r["type"] for r in rows(load(spark, f"{tmp_path}/a.md", structure="true"))] == ["frontmatter", "heading", "text", "code"]
    (tmp_path / "a.xml").write_text('<r><u id="1"><n>x</n></u></r>')
    assert [r["path"] for r in rows(load(spark, f"{tmp_path}/a.xml"))] == ["/r", "/r/u", "/r/u/n"]
    (tmp_path / "a.table").write_text("| a | b |\n|---|---|\n| 1 | x |\n| 2 | |\n")
    assert rows(load(spark, f"{tmp_path}/a.table")) == [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "b.html").write_text("<table><tr><th>a</th></tr><tr><td>5</td></tr></table>")
    assert rows(load(spark, f"{tmp_path}/b.html")) == [{"a": 5}]
    (tmp_path / "c.lcov").write_text("SF:f.py\nFN:1,3,go\nFN:5,other\nFNDA:2,go\nFNDA:0,other\nDA:1,2\nDA:2,0\nDA:6,1\nBRDA:2,0,0,-\nend_of_record\n")
    from recordflow import coverage

    facts = load(spark, f"{tmp_path}/c.lcov")
    assert rows(coverage.files(facts))[0]["hit_lines"] == 2
    assert {r["name"]: (r["lines"], r["hit_lines"]) for r in rows(coverage.functions(facts))} == {"go": (2, 1), "other": (1, 1)}


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, 2.0, True), ("y,z", 2, None, False)], "n string, i long, d double, b boolean").coalesce(1)
    save(df, f"{tmp_path}/o.xlsx")
    assert rows(load(spark, f"{tmp_path}/o.xlsx")) == [{"n": "x", "i": 1, "d": 2, "b": True}, {"n": "y,z", "i": 2, "d": None, "b": False}]
    assert rows(load(spark, f"{tmp_path}/o.xlsx?mode=stats"))[0]["rows"] == 3
    assert load(spark, f"{tmp_path}/o.xlsx?mode=raw&range=A1:B2").count() == 4
    save(df, f"{tmp_path}/o.csv")
    assert rows(load(spark, f"{tmp_path}/o.csv?delimiter=comma"))[0] == {"n": "x", "i": "1", "d": "2", "b": "true"}
    save(df, f"{tmp_path}/o.yaml")
    assert load(spark, f"{tmp_path}/o.yaml").count() == 2
    save(df.limit(1), f"{tmp_path}/o.toml")
    assert rows(load(spark, f"{tmp_path}/o.toml"))[0]["n"] == "x"
    save(df, f"{tmp_path}/o.xml")
    assert load(spark, f"{tmp_path}/o.xml").where("tag = 'record'").count() == 2
    save(df, f"{tmp_path}/o.jsonl.gz")
    assert load(spark, f"{tmp_path}/o.jsonl.gz").count() == 2
    assert json.loads(to_json(df)) == [{"n": "x", "i": 1, "d": 2.0, "b": True}, {"n": "y,z", "i": 2, "b": False}]
    assert table_text(df.select("n", "i"), "pipe").splitlines()[0] == "| n   | i |"
    with pytest.raises(ValueError):
        save(df, "https://h/x.json")


def test_profiles(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("WHERE", str(tmp_path))
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.jsonl").write_text('{"x": 1, "l": "e"}\n{"x": 2, "l": "w"}\n')
    root = tmp_path / "p"
    (root / "ns").mkdir(parents=True)
    (root / "_meta.json").write_text('{"headers": {"a": "1"}}')
    (root / "ns" / "_meta.json").write_text('{"headers": {"b": "${NONE:-2}"}}')
    (root / "ns" / "files.json").write_text('{"pattern": "${WHERE}/data/*.jsonl", "filter": "select(.l == \\"e\\")"}')
    (root / "ns" / "q.sql").write_text("-- rows by label\nselect count(*) as n from v where (:l is null or l = $l)")
    p = Profiles(str(root))
    assert p.load("ns/files")["headers"] == {"a": "1", "b": "2"}
    assert load(spark, "@ns/files", profiles=p).count() == 1
    load(spark, f"{tmp_path}/data/a.jsonl").createOrReplaceTempView("v")
    assert rows(load(spark, "@ns/q?l=w", profiles=p)) == [{"n": 1}] and rows(load(spark, "@ns/q", profiles=p)) == [{"n": 2}]
    assert [(x["name"], x["type"], x["params"]) for x in p.names()] == [("ns/files", "file", []), ("ns/q", "sql", ["l"])]
    assert sql_parameters("select ':no', :a -- :b\n, $c, x::int") == ["a", "c"] and substitute("${NO:-d}", {}) == "d"
    assert shell(spark, ["printf", "a\nb\n"]).count() == 2
