"""Ids, decoded texts and digests against the tokenizers library, on whole texts of many kinds."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from recordflow.llm import bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()

ODD = [
    "", " ", "\n\t ", "Hello, World! 12345", "don't we'll they've I'm you're he'd it's o'clock 'S 'tis ''s", "ÄÖÜ äöü ß Éé çÇ ñ × ÷ µ ª º",
    "Привет мир, это текст", "你好世界 漢字かな交じり文", "مرحبا بالعالم", "हिन्दी पाठ", "한국어 텍스트", "ไทย", "👩‍👩‍👧‍👦 🏳️‍🌈 ☕️", "é ä Å ﬁ     ​ ﻿ x",
    "<|startoftext|>", "a <|endoftext|> b<|startoftext|><|endoftext|>c", "<|endoftext", "<| x |>", "\0\x01\x7f\x80\xff", "a\u0000b", "İstanbul ǅ ŉ", "٣٤٥ ½ ² Ⅳ",
    "x" * 39, "x" * 40, "x" * 41, "ab" * 20 + "c", "é" * 20, "é" * 21, "z" * 500, "snake_case-and-kebab.dots/slashes\\back", "$$$ ### &&& *** %%%", "it's'them", "1st 22nd 3,000.50",
]


def made(seed, n):
    rng = random.Random(seed)
    plain = "abcdefghijklmnopqrstuvwxyz"
    kinds = [plain, plain.upper(), "0123456789", "'’.,;:!?-_()[]{}<>|/\\@#$%^&*+=~`\"", "äöüßéèêñçÄÖÜÉ", "абвгдЖЯ", "漢字かな한글", " \n\t\r\x0b\x0c", "́‍️", "👍🎉"]
    out = []
    for _ in range(n):
        weights = [rng.choice((0, 0, 1, 5)) + (k == 0) for k in range(len(kinds))]
        out.append("".join(rng.choice(rng.choices(kinds, weights)[0]) for _ in range(rng.randint(0, 120))))
    return out


def check(texts):
    bpe = B.load(PATH)
    ids, at = B.encode_batch(bpe, pa.array(texts, pa.large_string()))
    decoded = B.decode_batch(bpe, ids, at).to_pylist()
    for k, (text, want) in enumerate(zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True)):
        own = ids[at[k] : at[k + 1]].tolist()
        assert own == want.ids, repr(text)
        assert decoded[k] == LIBRARY.decode(own, skip_special_tokens=False), repr(text)


def test_odd_texts():
    check(ODD)
    for text in ODD:  # and each in a batch of its own
        check([text])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_made_texts(seed):
    check(made(seed, 1500))


def test_words_around_the_longest_of_the_trie():
    """Words of 30 to 60 bytes with shared beginnings, which stand in the arrays or are walked alone."""
    rng = random.Random(4)
    stems = ["".join(rng.choice("etaoinshr") for _ in range(60)) for _ in range(8)]
    check([" ".join(rng.choice(stems)[: rng.randint(30, 60)] + rng.choice(("", "s", "ing")) for _ in range(50)) for _ in range(20)])


def test_very_long_texts():
    rng = random.Random(5)
    check(["q" * 50_000, " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))) for _ in range(30_000)), "é漢" * 4000])


def test_words_share_their_prefixes():
    """The states of a shared prefix are computed once: the pairs that are looked at don't grow with repeats."""
    bpe = B.WordBPE(PATH)
    B.encode_batch(bpe, pa.array(["international internationally internationals"], pa.large_string()))
    before = len(bpe.compatible)
    B.encode_batch(bpe, pa.array(["international internationally internationals"] * 50, pa.large_string()))
    assert len(bpe.compatible) == before


def test_query(spark, monkeypatch):
    """Every row in order of the contract; small slices give the same; nulls, repeated rows, clashing columns."""
    rows = [(k, t) for k, t in enumerate([*ODD, *made(6, 100)]) if "\0" not in t] + [(900, None), (None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sums = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sums(np.array(ids, "<u4").tobytes()), sums(LIBRARY.decode(ids, skip_special_tokens=False).encode())))
    got = B.encode_documents(docs.selectExpr("*", "1 as ids", "2 as n_tokens", "3 as decoded"), PATH)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == sorted(want)
    monkeypatch.setattr(B.W, "SLICE_BYTES", 50)
    batch = pa.record_batch([pa.array([t for _, t in rows])], names=["text"])
    parts = [B.encode_batch(B.load(PATH), B.W.texts(p)) for p in B.W.slices(batch)]
    assert len(parts) > 20 and np.array_equal(np.concatenate([p[0] for p in parts]), B.encode_batch(B.load(PATH), B.W.texts(batch))[0])
    kept = B.encode_documents(docs.where("doc_id = 3 and text = 'again'"), PATH, keep_ids=True).collect()
    assert len(kept) == 2 and kept[0].ids == LIBRARY.encode("again", add_special_tokens=False).ids and kept[0].decoded == LIBRARY.decode(kept[0].ids, skip_special_tokens=False)
    assert B.encode_documents(docs.limit(0), PATH).count() == 0
