"""Runs of allowed bytes and CRCs against re and zlib."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa

from recordflow.llm import runs as R
from recordflow.llm import words as W


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_runs():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAZ09 .éÀÿ×汉ß\n-Ā") for _ in range(rng.randint(0, 50))) for _ in range(400)] + [None, "", "é", "a"]
    whole = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for batch in (whole, whole.slice(7, 100), whole.slice(400, 2), whole.slice(0, 0)):
        for pattern, allowed, latin in ((r"[a-zÀ-ÿ]+", R.LETTER, True), (r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", R.WORD, False)):
            flat, offsets, _ = R.runs(W.texts(batch), allowed, latin)
            flat.validate(full=True)
            flat = flat.to_pylist()
            assert [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [re.findall(pattern, lower(t)) for t in batch.column(0).to_pylist()]


def test_joined_crcs():
    rng = random.Random(2)
    first = [rng.randbytes(rng.randint(0, 50)) for _ in range(500)]
    second = [rng.randbytes(rng.choice((0, 1, 5, 127, 128, 129, 256, 257, 700))) for _ in range(500)]
    got = R.joined(np.array(list(map(zlib.crc32, first)), np.uint32), np.array(list(map(zlib.crc32, second)), np.uint32), np.array(list(map(len, second))))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(first, second, strict=True)]
