"""Against a direct version over all windows, on texts made to repeat."""

import hashlib
import random
import re

from pyspark.sql import types

from recordflow.llm import substring as S


def direct(rows, size):
    docs = sorted((i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows)
    seen, out = set(), {}
    for i, ws in docs:
        gone = set()
        for s in range(len(ws) - size + 1):
            w = tuple(ws[s : s + size])
            if w in seen:
                gone |= set(range(s, s + size))
            seen.add(w)
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def made(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["é", "«x»", "\xa0y"]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 70))] for _ in range(6)]
    rows = []
    for i in range(60):
        ws = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            at = rng.randint(0, len(ws))
            ws[at:at] = p[a : a + rng.randint(10, 60)]
        rows.append((i, rng.choice((" ", "\n", "\t ")).join(ws)))
    rows += [(100 + k, rows[5][1]) for k in range(5)]
    return [*rows, (200, "same " * 300), (201, "same " * 25), (202, None), (203, ""), (204, "same " * 19), (205, " ".join(rng.choice(words) for _ in range(4000)) + rows[7][1])]


def test_against_direct(spark, monkeypatch):
    """Both sides of each switch: frequent anchors window by window, one or many shards, one or many tasks for an automaton."""
    for seed, often, shard, stream in ((1, 2000, 100_000, 200_000), (2, 3, 500, 20)):
        monkeypatch.setattr(S, "FREQUENT", often)
        monkeypatch.setattr(S, "SHARD_WORDS", shard)
        monkeypatch.setattr(S, "STREAM", stream)
        rows = made(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.dedup_substrings(docs.selectExpr("*", "1 as words", "2 as starts", "3 as copy", "4 as sha")).collect()}
        assert got == direct(rows, 20)


def test_a_passage_in_most_documents(spark):
    """A phrase of several hundred documents, of which one batch holds more than HOT."""
    rng = random.Random(3)
    common = [f"c{k}" for k in range(33)]
    rows = [(i, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))), *common[rng.randint(0, 5) :], *(f"w{rng.randrange(10**6)}" for _ in range(9))])) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.dedup_substrings(docs).collect()}
    assert got == direct(rows, 20)


def test_the_automaton_finds_the_places(spark):
    """Hits come from the automaton, those of equal symbols are told apart, and without phrases nothing is found."""
    words = [f"v{k}" for k in range(60)]
    shown = [{"words": " ".join(words[:25]), "offsets": [0, 3], "docs": [4, 4], "starts": [10, 13]}, {"words": " ".join(words[30:50]), "offsets": [0], "docs": [2], "starts": [0]}]
    stream = S.pa.array([" ".join(["x", *words[:30]]), "y", " ".join(words[25:55])], S.pa.large_string())
    found = S.Phrases(shown, 20).hits(stream)
    assert sorted(zip(*(c.tolist() for c in found), strict=True)) == [(0, 1, 0), (0, 4, 1), (2, 5, 2)]
    plain = S._symbols
    try:
        S._symbols = lambda h: plain(h) * 0 + 65  # all words look alike
        found = S.Phrases(shown, 20).hits(stream)
    finally:
        S._symbols = plain
    assert sorted(zip(*(c.tolist() for c in found), strict=True)) == [(0, 1, 0), (0, 4, 1), (2, 5, 2)]
    kind = types.ArrayType(types.StructType.fromDDL("words string, offsets array<bigint>, docs array<bigint>, starts array<bigint>"))
    rows = [(0, 0, shown, None, None, None), (0, 0, None, 9, 100, " ".join(words[:25])), (1, 0, None, 9, 200, " ".join(words[:25]))]
    frame = spark.createDataFrame(rows, types.StructType.fromDDL("shard long, salt long").add("phrases", kind).add("doc_id", "long").add("start", "long").add("words", "string")).coalesce(1)
    assert [tuple(r) for r in S.locate(frame, 20).collect()] == [(9, [100, 103])]


def test_texts_stay_where_nothing_repeats(spark):
    text = " ".join(f"a{k}" for k in range(30))
    rows = [(1, "x  y\n" + text, "en"), (2, "q " + text + " z", "en"), (3, None, None), (3, None, None)]
    clash = S.without_repeats(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, _kept string, kept long, row long, starts long")).orderBy("doc_id").collect()
    assert [tuple(r) for r in clash][1] == (2, "q z", "en", 1, 2, 3)
    out = S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, "x  y\n" + text, "en"), (2, "q z", "en"), (3, None, None), (3, None, None)]
    assert S.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
