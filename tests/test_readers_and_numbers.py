"""Globs below folders, lineage, compressed documents, numbers of a stream, and functions at their limits."""

import gzip
import os

from recordflow.operators import numbered
from recordflow.plans import apply
from recordflow.sources import load


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_globs_and_lineage(spark, tmp_path):
    base = str(tmp_path)
    write(f"{base}/a/logs/1.csv", b"a,b\n1,2\n3,4,5\n")
    write(f"{base}/b/x/logs/2.csv", b"a,b\n5,6,7,8\n")
    write(f"{base}/b/3.csv", b"a,b\n9,9\n")
    write(f"{base}/a/q.yaml", b"- x: 1\n- x: 2\n")
    write(f"{base}/b/r.yaml.gz", gzip.compress(b"x: 3\n"))
    assert sorted(r.a for r in load(spark, f"{base}/**/*.csv").collect()) == ["1", "3", "5", "9"]
    got = load(spark, f"{base}/**/logs/*.csv", index=True).orderBy("_file_index", "_line_index").collect()
    assert [(r._filename, r._basename, r._file_index, r._line_index, r.a, r._extra0, r._extra1) for r in got] == [("1.csv", "1", 0, 0, "1", None, None), ("1.csv", "1", 0, 1, "3", "5", None), ("2.csv", "2", 1, 0, "5", "7", "8")]
    got = load(spark, f"{base}/**/*.yaml*~yaml", lineage=True).orderBy("x").collect()
    assert [(r.x, r._filename, r._ext) for r in got] == [(1, "q.yaml", ".yaml"), (2, "q.yaml", ".yaml"), (3, "r.yaml.gz", ".gz")]
    assert load(spark, f"{base}/b/r.yaml.gz").columns == ["x"]


def test_line_index_over_blocks(spark, tmp_path):
    """A file that several tasks read in blocks is numbered as a whole."""
    write(f"{tmp_path}/x.jsonl", b"".join(b'{"k":%d}\n' % k for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert all(r.k == r._line_index and r._file_index == 0 for r in load(spark, f"{tmp_path}/x.jsonl", index=True).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numbered(spark):
    df = spark.range(5000).selectExpr("if(id % 50 = 0, null, id % 97) as k", "cast(id as string) as v", "id as seq_", "id as _range")
    got = numbered(df, ["k", "seq_"], "n", start=0).orderBy("n").collect()
    assert [r.n for r in got] == list(range(5000))
    key = [(-1 if r.k is None else r.k, r.seq_) for r in got]
    assert key == sorted(key) and got[0]._range is not None
    assert [r.n for r in numbered(df, ["v"], "n").orderBy("v").limit(3).collect()] == [1, 2, 3]
    assert numbered(df.limit(0), ["k"]).count() == 0
    text = spark.range(3000).selectExpr("concat(char(97 + id % 26), if(id % 7 = 0, 'é', 'zz'), id) as v", "timestamp_seconds(id * 977 % 3001) as at")
    for c in ("v", "at"):
        got = [getattr(r, c) for r in numbered(text, [c], "n").orderBy("n").collect()]
        assert got == [getattr(r, c) for r in text.orderBy(c).collect()]


def test_limits(spark):
    df = spark.sql("select cast(-2147483648 as int) i, cast(-128 as tinyint) b, -9223372036854775807 - 1 l, -1.5D d")
    r = apply(df, "{i: (.i|abs), b: (.b|negate), l: (.l|fabs), d: (.d|abs), e: (.l|incr), f: (.l|decr)}").collect()[0]
    assert (r.i, r.b, r.l, r.d, r.e, r.f) == (None, None, None, 1.5, -(2**63) + 1, None)
    (r,) = apply(df, '{v: ({a: 1, b: "x]\\"", c: null} | values), w: ({a: 1, b: 2} | values)}').collect()
    assert r.v == ["1", '"x]\\""', "null"] and r.w == [1, 2]
