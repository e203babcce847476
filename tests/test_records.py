"""A format of its own: pushed filters, commits, failures; and a table function by partition."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from recordflow.sources import register_records


@pytest.fixture
def path(spark, tmp_path):
    register_records(spark)
    return f"{tmp_path}/t"


def names(path):
    return sorted(n for n in os.listdir(path) if n != "manifest.json")


def test_round_trip_and_pushed_filters(spark, path):
    rows = spark.range(4000).selectExpr("id", "concat('n', id % 7) as name", "case when id % 10 > 0 then id / 4 end as v", "array(id, id + 1) as a", "struct(id % 3 as x) as s", "id % 2 = 0 as even")
    rows.repartitionByRange(8, "id").write.format("records").mode("append").save(path)
    df = spark.read.format("records").load(path)
    load = lambda: spark.read.format("records").option("push", "true").load(path)
    assert df.schema.simpleString() == rows.schema.simpleString() and len(names(path)) == 8
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, rows.collect()))
    for push in (False, True):
        for where in ("id = 17", "id > 3990", "id >= 3990 and v < 998", "name in ('n1', 'n9') and id <= 40", "even and v is not null", "v is null", "s.x = 1", "id = 99999", "name like 'n2%' or id < 3"):
            assert sorted(map(tuple, (load() if push else df).where(where).collect())) == sorted(map(tuple, rows.where(where).collect())), where
    plan = load().where("id = 17 and name > 'n2' and s.x = 2")._jdf.queryExecution().executedPlan().toString()
    assert "id#" in plan and "= 17" not in plan and "n2" not in plan and "s#" in plan and ".x" in plan  # what was pushed is no filter of Spark's any more
    assert load().where("id = 17").rdd.getNumPartitions() == 1 and load().rdd.getNumPartitions() == 8  # files that cannot hold the row are not read


def test_modes(spark, path):
    rows = spark.range(10).select(F.col("id"), F.lit("x").alias("t"))
    for mode, n in (("append", 10), ("append", 20), ("overwrite", 10)):
        rows.write.format("records").mode(mode).save(path)
        df = spark.read.format("records").load(path)
        assert df.count() == n
    assert len(names(path)) == len({r.f for r in rows.select(F.spark_partition_id().alias("f")).collect()})
    rows.limit(0).write.format("records").mode("overwrite").save(path)
    assert spark.read.format("records").load(path).count() == 0 and names(path) == []


def test_a_failed_task_leaves_nothing(spark, path):
    spark.range(5).write.format("records").mode("append").save(path)
    before = names(path)
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") < 990, F.col("id")).otherwise(F.raise_error(F.lit("broken row")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="broken row"):
        bad.write.format("records").mode("overwrite").save(path)
    assert names(path) == before and spark.read.format("records").load(path).count() == 5
    with pytest.raises(Exception, match="no table of records"):
        spark.read.format("records").load(path + "-none").count()


def test_sessions(spark, path):
    begin = dt.datetime(2024, 1, 1)
    rows = [(u, u * 100 + i, begin + dt.timedelta(seconds=s)) for u in (1, 2) for i, s in enumerate((0, 5, 16, 17, 100))]
    spark.createDataFrame(rows, "user long, id long, at timestamp").repartition(3).createOrReplaceTempView("seen")
    got = spark.sql("select * from sessions(table(select user, id, at from seen) partition by user order by (at), 10)").collect()
    assert sorted((r.id, r.session, r.place) for r in got) == sorted((u * 100 + i, *x) for u in (1, 2) for i, x in enumerate(((1, 1), (1, 2), (2, 1), (2, 2), (3, 1))))
