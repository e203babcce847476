"""Held-out accuracy, spans of mixed texts, and Viterbi against all paths."""

import itertools
import random

import numpy as np

from recordflow.llm import langid as L

STEMS = {"aa": ("the", "ing", "tion", "wh"), "bb": ("sch", "ung", "keit", "der"), "cc": ("мир", "ать", "ово", "при")}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = rng.integers(0, 6, 5)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        score = rng.normal(size=(offsets[-1], 3)) * 3
        got = L.viterbi(score, offsets, 2.0)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            value = lambda p, a=a: sum(score[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))
            best = max((value(p) for p in itertools.product(range(3), repeat=b - a)), default=0)
            assert abs(value(got[a:b].tolist()) - best) < 1e-9


def test_languages(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, rng.randint(3, 50)), lang) for i, lang in enumerate(list(STEMS) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(docs.where("doc_id % 4 <> 2"))
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in L.label(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    odd = [(1, None), (2, ""), (3, "123 ... !!"), (4, text(rng, "aa", 30) + " " + text(rng, "bb", 20) + " 12 " + text(rng, "cc", 5)), (5, "同 文"), (5, "同 文")]
    rows = L.label(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as lang"), model, spans=True).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score) for r in rows[:3]] == [("und", 0.0)] * 3
    assert [s.lang for s in rows[3].spans] == ["aa", "bb", "cc"] and rows[3].lang_pred == "aa" and rows[3].spans[0].end == 30
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)


def test_texts_without_blanks(spark):
    """Characters of scripts without blanks are words of their own, so spans inside such a text are found."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("ひらがなとかな", "ja"), ("漢字汉语文本", "zh"), ("the cat sat", "en")] * 5)]
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = "漢字汉语文本" * 3 + "ひらがなとかな" * 3 + " the cat"
    (r,) = L.label(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, spans=True).collect()
    assert [(s.lang, s.first, s.end) for s in r.spans] == [("zh", 0, 18), ("ja", 18, 39), ("en", 39, 41)] and r.lang_pred == "ja"


def test_only_candidates_are_scored(spark):
    """A language without the script never wins a word; the sample is bounded, and the same in any layout."""
    rng = random.Random(4)
    rows = [(i, text(rng, lang, 12), lang) for i, lang in enumerate(list(STEMS) * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, again = L.learn(docs, 20), L.learn(docs.repartition(5).selectExpr("*", "1 as k", "2 as h", "3 as bound", "4 as n"), 20)
    assert np.array_equal(model.table, again.table) and np.array_equal(model.uses, again.uses)
    c = L.coded(L.pa.array(["the", "мир", "12"], L.pa.large_string()))
    score = model.scores(c)
    assert score[0].argmin() == 2 and score[1].argmax() == 2 and (score[1, :2] <= score[1, 2] - L.BARRED).all() and not score[2].any()


def test_long_texts_ties_and_clashing_columns(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, lang, 40), lang) for i, lang in enumerate(list(STEMS) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(docs)
    half = text(rng, "bb", 1)
    long = " ".join(text(rng, lang, 20_000) for lang in ("cc", "bb", "cc"))
    odd = spark.createDataFrame([(1, long), (None, long), (2, half), (2, half)], "doc_id long, text string").selectExpr("*", "1 as lang_pred", "2 as score", "3 as lang")
    got = L.label(odd, model, spans=True).collect()
    assert len(got) == 4 and {r.lang_pred for r in got if r.doc_id != 2} == {"cc"} and all(len(r.spans) == 3 for r in got if r.doc_id != 2)
    same = L.Model(["aa", "bb"], np.zeros((L.CLASSES, 2), np.float32), np.ones((len(L.NAMES), 2), bool))
    assert {r.lang_pred for r in L.label(odd, same).collect()} == {"aa"}  # ties go by name


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = L.learn(docs)
    assert [r.lang_pred for r in L.label(docs, model).collect()] == ["und"]
    assert L.label(docs.limit(0), model).count() == 0
