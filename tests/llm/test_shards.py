"""Binary shards: fixed stride, read by seek; the order of training hangs on the documents alone."""

import os

import numpy as np
import public_tokenizers

from recordflow.llm import materialize as M

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [(i, "some tokens " * (i * 3)) for i in range(40)] + [(None, "no id"), (7, "again"), (7, "again"), (7, "other"), (101, None), (101, "")]


def test_order_does_not_hang_on_partitions(spark):
    def run(rows, n):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        return sorted((r.slot, r.doc_id, r.piece, bytes(r.payload)) for r in M.materialize(docs, PATH, length=16, shard_rows=10, key=3).collect())

    first = run(ROWS, 1)
    assert run(ROWS[::-1], 5) == first and run(ROWS[20:] + ROWS[:20], 3) == first


def test_binary_shards(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = sorted(M.materialize(docs, PATH, length=16, shard_rows=10, key=3, folder=f"file://{tmp_path}/s").collect(), key=lambda r: r.slot)
    files = sorted(f for f in os.listdir(tmp_path / "s") if f.endswith(".bin"))
    assert len(files) == -(-len(got) // 10)
    assert [os.path.getsize(tmp_path / "s" / f) for f in files] == [320] * (len(files) - 1) + [len(got) * 32 - 320 * (len(files) - 1)]
    for r in got:
        with open(r.file.removeprefix("file://"), "rb") as f:
            f.seek(r.byte_offset)
            assert f.read(32) == bytes(r.payload)
    rest = list(M.read_slots(f"{tmp_path}/s/{files[1]}", from_byte=4 * 32))
    assert [x.tolist() for x in rest] == [np.frombuffer(r.payload, "<u2").tolist() for r in got[14:20]]
