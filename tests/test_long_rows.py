"""Rows of a CSV longer than its header keep all values."""

from recordflow.sources import load


def test_csv_long_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,2\n3,4,"x,y",z\n5\n"p,q,r,s,t",6\n')
    out = load(spark, f"{tmp_path}/a.csv?delimiter=comma")
    assert out.columns == ["a", "b", "_extra0", "_extra1"]
    assert [tuple(r) for r in out.collect()] == [("1", "2", None, None), ("3", "4", "x,y", "z"), ("5", None, None, None), ("p,q,r,s,t", "6", None, None)]
    got = load(spark, f"{tmp_path}/a.csv?delimiter=comma", header="false")
    assert got.columns == ["col0", "col1", "col2", "col3"] and got.count() == 5
    assert "_path" in load(spark, f"{tmp_path}/a.csv?delimiter=comma", lineage=True).columns


def test_csv_lines_are_written_by_many_tasks(spark, tmp_path):
    """No task sorts the whole table: a file for each range of rows, in order, each with the header, none of which becomes a row."""
    from recordflow.catalogue_files import _csv_text

    rows = spark.range(5000).selectExpr("(id * 7919) % 5000 as k")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        _csv_text(rows, "concat_ws(',', k, k % 3, if(k = 4321, 'z', null))", f"{tmp_path}/x.csv", "k", "a,b")
        _csv_text(rows.limit(0), "string(k)", f"{tmp_path}/none.csv", "k", "a,b")
    finally:
        spark.conf.unset(setting)
    files = sorted(tmp_path.glob("x.csv/*.txt"))
    assert len(files) == 4
    lines = [f.read_text().splitlines() for f in files]
    assert all(x[0] == "a,b" and len(x) < 3000 for x in lines)
    assert [int(y.split(",")[0]) for x in lines for y in x[1:]] == list(range(5000))
    got = load(spark, f"{tmp_path}/x.csv")
    assert got.columns == ["a", "b", "_extra0"] and got.count() == 5000 and got.where("_extra0 = 'z'").count() == 1
    assert load(spark, f"{tmp_path}/none.csv").columns == ["a", "b"]
