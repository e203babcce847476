"""Tables between steps: where they stand, when they go, what is broadcast, and sums of arrays."""

import numpy as np
import pytest

from recordflow.llm import store


def folders(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(store.shared_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in fs.listStatus(path)} if fs.exists(path) else set()


class Session:
    """As much of a session as says where the shared folder is."""

    def __init__(self, **settings):
        self.settings = settings
        self.conf = self.sparkContext = self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def getConf(self):  # noqa: N802
        return self


def test_shared_folder_is_the_cluster_s(spark):
    there = {"spark.sql.warehouse.dir": "file:/w/"}
    assert store.shared_dir(Session(**there)) == "file:/w/recordflow-checkpoints"
    assert store.shared_dir(Session(**there, **{"spark.checkpoint.dir": "hdfs://x/shared"})) == "hdfs://x/shared"


def test_tables_are_deleted_when_nothing_reads_them(spark):
    before = folders(spark)
    kept = store.cut(spark.range(10).toDF("k"), "kept")

    @store.tidy
    def operator():
        a = store.cut(spark.range(100).toDF("k"), "a")
        b = store.cut(a.join(kept, "k"), "b")
        return b.selectExpr("k + 1 as k")

    out = operator()
    assert sorted(r.k for r in out.collect()) == list(range(1, 11))
    new = folders(spark) - before
    assert len(new) == 2 and not any("-a-" in f for f in new)
    store.drop(kept)
    assert len(folders(spark) - before) == 1


def test_operators_in_threads_keep_their_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    before = folders(spark)

    @store.tidy
    def inner(n):
        kept = store.cut(spark.range(n).toDF("k"), "inner")
        store.cut(kept.selectExpr("k + 1 as k"), "gone")
        return kept

    @store.tidy
    def outer(n):
        a = inner(n)
        b = store.cut(a.selectExpr("k * 2 as k"), "outer")
        store.drop(a)
        return b

    def work(n):
        return [outer(n).agg({"k": "sum"}).first()[0] for _ in range(4)]

    setting = spark.conf.get(store._CLEANUP, "false")
    with ThreadPoolExecutor(3) as pool:
        assert list(pool.map(work, (10, 200, 3000))) == [[n * (n - 1)] * 4 for n in (10, 200, 3000)]
    assert spark.conf.get(store._CLEANUP, "false") == setting and not store._WRITES
    new = folders(spark) - before
    assert len(new) == 12 and all("-outer-" in f for f in new)


@pytest.mark.parametrize("rows", [3, 1_000_000])
def test_small_tables_only_are_broadcast(spark, monkeypatch, rows):
    monkeypatch.setattr(store, "SMALL_ROWS", rows)
    left, right = spark.range(50).toDF("k"), spark.range(10).toDF("k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(store.small(right), "k")
        assert joined.count() == 10
        assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) == (rows > 10)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sums_and_samples(spark):
    def count(batches):
        total = np.zeros(10_000, np.int64)
        for b in batches:
            total += np.bincount(b.column("v").to_numpy(), minlength=10_000)
        return total

    df = spark.range(30_000).selectExpr("id % 9999 as v").repartition(7)
    assert np.array_equal(store.summed(df, count, 10_000), np.bincount(np.arange(30_000) % 9999, minlength=10_000))
    assert not store.summed(df.limit(0), count, 10_000).any()
    first = {r.k for r in store.first_by_hash(spark.range(20_000).toDF("k"), ["k"], 100, 20_000).collect()}
    again = {r.k for r in store.first_by_hash(spark.range(20_000).toDF("k").repartition(5), ["k"], 100, 20_000).collect()}
    assert len(first) == 100 and first == again
