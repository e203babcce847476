"""Words and shingles of batches that are cut into slices."""

import random
import re

import numpy as np
import pyarrow as pa

from recordflow.llm import words as W


def test_slices_give_the_same_words(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("AbC \t\x0b\x1c\xa0é ") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", " "]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    monkeypatch.setattr(W, "SLICE_BYTES", 200)
    parts = list(W.slices(batch))
    assert len(parts) > 10 and sum(p.num_rows for p in parts) == len(texts)
    for lower in (False, True):
        got = []
        for part in parts:
            flat, offsets = W.split(W.texts(part), lower)
            plain = flat.to_pylist()
            got += [plain[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
        if lower:
            want = [["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in ws] for ws in want]
        assert got == want


def test_shingles():
    h = W.word_hashes(pa.array(list("abcdefg") + ["x"], pa.large_string()))
    s, at = W.shingles(h, np.array([0, 7, 7, 8]), 5)
    assert at.tolist() == [0, 3, 3, 4] and len(set(s.tolist())) == 4
    again, _ = W.shingles(W.word_hashes(pa.array(list("cdefg"), pa.large_string())), np.array([0, 5]), 5)
    assert again[0] == s[2]
