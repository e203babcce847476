"""Near words, forms and roots against all pairs and a plain edit distance."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from recordflow.llm import spelling as S


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def near(a, b):
    """Whether exactly one edit makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def direct(counts, ratio=2):
    out, form = {}, {}
    for w, n in counts.items():
        around = [x for x in counts if near(w, x)]
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * n:
            form[w] = best
        out[w] = [n, len(around)]
    for w, (n, k) in out.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, k, counts[form[w]] if w in form else None)
    return out


def rows(df):
    got = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert len({r.word for r in got}) == len(got)
    return {r.word: tuple(r)[1:] for r in got}


def test_against_all_pairs(spark):
    rng = random.Random(4)
    words = set()
    while len(words) < 500:
        words.add("".join(rng.choice("aabéÿ") for _ in range(rng.randint(1, 7))))
    counts = {w: rng.choice((1, 2, 3, 4, 8, 9, 40, 200)) for w in words}
    long = "ab" * 3000
    counts |= {long: 9, long + "b": 3, "a" + long[:-1]: 2, long[:2000] + "x" + long[2001:]: 4, "日本語日本": 5, "日本語日": 50, "𝒳yzzy": 3, "𝒳yzy": 7}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert rows(S.spelling_groups(df)) == direct(counts)
    # chains longer than one: every word is near the one of twice its count
    chain = {"q" * k: 2**k for k in range(5, 30)}
    got = rows(S.spelling_groups(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert {r[1] for r in got.values()} == {"q" * 29} and got["q" * 29][0] is None


def test_deletions_are_distinct():
    words = pa.array(["aab", "abb", "aaaa", "x"], pa.large_string())
    of, k1, k2, i, j = S.deletions(words)
    found = {}
    for w, a, b in zip(of.tolist(), k1.tolist(), k2.tolist(), strict=True):
        found.setdefault((a, b), []).append(words[w].as_py())
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, (["aab"], ["abb"], ["aaaa"], ["x"], ["aab", "abb"], ["aab"], ["abb"], ["aaaa"], ["x"])))


@pytest.mark.parametrize("held", [1, S.HELD])
def test_texts(spark, monkeypatch, held):
    monkeypatch.setattr(S, "HELD", held)
    rng = random.Random(5)
    base = ["Hello", "hallo", "world", "worlds", "wörld", "ÀÉÎÕÿ", "tiny", "abc"]
    docs = [(i, " ".join(rng.choice(base) for _ in range(60)) + rng.choice((".", "\n7x", ""))) for i in range(120)] + [(None, "Hello hello world1world"), (None, None), (500, ""), (501, None), (7, "hello hello"), (7, "hello hello"), (600, "hello " * 30_000)]
    counts = Counter()
    for i, text in docs:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 7 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    want = direct({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as word", "2 as id").repartition(3)
    assert rows(S.spelling_variants(df, every=7)) == want and len(want) > 6
    plain = S.word_counts(df, least_chars=1, least_count=1)
    assert {r.word: r.n for r in plain.collect()} == Counter(lower(w) for _, t in docs for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""))


def test_small_tables(spark):
    assert rows(S.spelling_variants(spark.createDataFrame([], "doc_id long, text string"))) == {}
    assert rows(S.spelling_variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))) == {}
    assert rows(S.spelling_groups(spark.createDataFrame([("word", 4), (None, 3), ("ward", None)], "word string, n long"))) == {"word": (None, "word", 4, 0, None)}
    with pytest.raises(ValueError):
        S.spelling_groups(spark.createDataFrame([("word", 4)], "word string, n long"), ratio=1)


def test_tables_of_words_are_not_broadcast(spark, monkeypatch):
    plans = []

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def cut(df, name, *rest):
        if name != "words":  # numbering broadcasts a row for each range
            plans.append(plan(df))
        return made(df, name, *rest)

    made = S.cut
    monkeypatch.setattr(S, "cut", cut)
    counts = {"q" * k: 2**k for k in range(5, 30)} | {"wörld": 3, "world": 40, "words": 7}
    got = S.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert rows(got) == direct(counts)
    assert sum("SortMergeJoin" in p for p in plans) > 2
    assert not any("BroadcastHashJoin" in p for p in [*plans, plan(got)])
