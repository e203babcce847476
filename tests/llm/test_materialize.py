"""Slots are a permutation, shards hold the library's ids, reads resume."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recordflow.llm import materialize as M

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_permutation():
    for count in (1, 2, 3, 10, 64, 65, 1000, 4097):
        got = M.permute(np.arange(count), count, 7)
        assert sorted(got.tolist()) == list(range(count))
    assert (M.permute(np.arange(1000), 1000, 7) != M.permute(np.arange(1000), 1000, 8)).any()


def test_round_trip(spark, tmp_path):
    rows = [(i, "some tokens " * (i * 3)) for i in range(40)] + [(100, None), (101, ""), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = M.materialize(docs.selectExpr("*", "1 as slot", "'x' as payload"), PATH, length=16, shard_rows=10, key=3, folder=str(tmp_path / "s")).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k // 16, ids[k : k + 16]) for k in range(0, len(ids), 16)]
    assert sorted((r.doc_id, r.piece, np.frombuffer(r.payload, "<u2")[: r.n_tokens].tolist()) for r in got) == sorted(want)
    assert all(len(r.payload) == 32 and r.byte_offset == r.slot % 10 * 32 and r.shard == r.slot // 10 for r in got)
    rest = M.read_shard(spark, str(tmp_path / "s"), 1, from_byte=4 * 32).collect()
    assert [r.slot for r in rest] == list(range(14, 20))


def test_long_text_and_many_equal_rows(spark):
    """A text of many sequences and a text that stands in many rows: every slot once, whole shards of several tasks."""
    rows = [(1, "word " * 60_000), *[(2, "same text here")] * 3000, *[(None, None)] * 500]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = M.materialize(docs, PATH, length=64, shard_rows=100, key=9).select("slot", "doc_id", "n_tokens").collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert sum(r.doc_id == 2 for r in got) == 3000 and sum(r.doc_id is None for r in got) == 500 and sum(r.n_tokens for r in got if r.doc_id == 1) == 60_001


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    assert M.materialize(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == n
