"""Scores and ranks against a direct version, with and without chunks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from recordflow.llm import resample as S


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, longest):
    ws = words_of(text)
    return [" ".join(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]


def direct(docs, target, longest=2, buckets=500, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, longest)) for texts in ([d[1] for d in docs], target))
    total = [sum(c.values()) + buckets for c in (s, t)]
    gain = [math.floor(1000 * math.log((t[b] + 1) * total[0] / ((s[b] + 1) * total[1]))) for b in range(buckets)]
    out = []
    for i, text in docs:
        fs = features(text, longest)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(fs), weight, score, None, i is not None and len(words_of(text)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def corpus():
    rng = random.Random(8)
    vocabulary = [rng.choice(("Wort", "été", "汉字", "x", "go2")) + str(k) for k in range(90)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice((" ", ", ", "\n", "--")) for _ in range(n))
    docs = [(i * 3, text(rng.choice((0, 1, 2, 19, 20, 21, 60)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, " .,- "), (None, text(40)), (None, None), (1003, docs[9][1]), (27, docs[9][1]), (27, docs[9][1])]
    big = text(4000)
    docs += [(1004, big), (1004, big), (1005, big), (1006, "...." * 2000), (1007, "y" * 5000), (1008, text(700))]
    return docs, [text(30) for _ in range(12)] + [None, "", text(2500)]


@pytest.mark.parametrize(("longest", "chunk", "words"), [(2, S.CHUNK, S.CHUNK_WORDS), (2, 200, 7), (3, 50, 1), (1, 300, 40)])
def test_against_direct(spark, longest, chunk, words):
    docs, target = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' as weight", "1 as score", "2 as rank", "3 as sig", "4 as chunk").repartition(3)
    bench = spark.createDataFrame([(t,) for t in target], "text string").selectExpr("*", "9 as doc_id")
    got = S.resample(df, bench, longest=longest, buckets=500, chunk=chunk, words=words)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == direct(docs, target, longest)


def test_chunks_own_every_start_once(spark):
    docs, _ = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(dict.fromkeys(t for _, t in docs))], "doc_id long, text string")
    found = {}
    for r in S.chunks(df, ["doc_id"], "text", longest=3, words=5).collect():
        ws = words_of(r.text)
        assert r.owned <= 5 and len(ws) <= r.owned + 2
        found.setdefault(r.doc_id, {})[r.chunk] = [" ".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(r.owned) if i + k <= len(ws)]
    for i, t in df.collect():
        assert Counter(f for part in found[i].values() for f in part) == Counter(features(t, 3))


def test_small_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(5, "one two " * 10)], "doc_id long, text string")
    assert S.resample(none, some).count() == 0
    (r,) = S.resample(some, none).collect()
    assert r.n_features == 39 and r["rank"] is None
    (r,) = S.resample(some, some, percent=100).collect()
    assert r.weight == 0 and r["rank"] == 1
