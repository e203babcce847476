"""Plans use the histogram up; sequences are gapless; pieces are the library's ids."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from recordflow.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_plan_uses_everything_and_packs_well():
    rng = np.random.default_rng(1)
    for n, capacity in ((0, 10), (1, 10), (5000, 64), (40_000, 2048)):
        lengths = np.minimum(capacity, 1 + rng.exponential(capacity / 3, n).astype(int))
        histogram = np.bincount(lengths, minlength=capacity + 1)
        used = np.zeros(capacity + 1, np.int64)
        count = 0
        for p, times in packing.plan(histogram):
            assert sum(p) <= capacity
            for v in p:
                used[v] += times
            count += times
        assert (used == histogram).all()
        assert count <= -(-int(lengths.sum()) // capacity) * 1.01 + 2


def test_fit_is_close_to_an_exact_mixture():
    patterns = [(10,), (7, 3), (5, 5), (4, 3, 3)]
    histogram = np.zeros(11, np.int64)
    for p, times in zip(patterns, (40, 100, 30, 50), strict=True):
        for v in p:
            histogram[v] += times
    assert np.allclose(packing.fit(patterns, histogram), (40, 100, 30, 50), atol=1)


def test_documents(spark):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(("hello", "World", "tokens!", "naïve", "42")) for _ in range(rng.randint(0, 300))) for i in range(120)}
    texts |= {200: None, 201: "", 202: "x " * 3000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack_documents(docs.selectExpr("*", "1 as length", "2 as piece"), PATH, capacity=256).collect()
    library = Tokenizer.from_file(PATH)
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, {})[r.piece] = r
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 256):
            r = by_doc[i][k // 256]
            own = ids[k : k + 256]
            assert (r.start, r.length, r.ids_crc32) == (k, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        assert len(by_doc[i]) == -(-len(ids) // 256)
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 256) + 2
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "same text")] * 5, "doc_id long, text string")
    rows = packing.pack_documents(docs, PATH, capacity=4).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 5
