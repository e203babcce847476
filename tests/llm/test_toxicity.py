"""Exact neighbours against brute force, held-out accuracy, and odd rows."""

import random

import numpy as np
import pytest

from recordflow.llm import toxicity as T


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    plain = [f"w{i}" for i in range(300)]
    bad = ["vilest", "rotten", "grubbers", "grubbing"]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 60))]
        if i % 6 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(("", "!!", ","))
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    return docs, labels


def fitted(spark, rows):
    docs = spark.createDataFrame(rows[0], "doc_id long, text string")
    labels = spark.createDataFrame([x for x in rows[1] if x[0] % 5], "doc_id long, toxic int")
    return docs, T.fit(docs, labels.selectExpr("*", "'x' as text"))


def test_held_out(spark, rows):
    docs, index = fitted(spark, rows)
    got = {r.doc_id: r for r in T.score(docs.selectExpr("*", "1 as score"), index).collect()}
    truth = dict(rows[1])
    held = [i for i in truth if i % 5 == 0]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    evidence = next(r for r in got.values() if r.predicted)
    assert evidence.evidence and evidence.cosines == sorted(evidence.cosines, reverse=True)
    kept = {r.doc_id for r in T.keep_clean(docs, index).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def dense_of(index):
    dense = np.zeros((len(index.ids), len(index.terms)))
    for t in range(len(index.terms)):
        lo, hi = index.starts[t], index.starts[t + 1]
        dense[index.examples[lo:hi], t] = index.weights[lo:hi]
    return dense


def test_neighbours_are_exact(spark, rows):
    """Against brute force over whole vectors, with queries that share long lists, short ones, or none."""
    _, index = fitted(spark, rows)
    dense = dense_of(index)
    rng = np.random.default_rng(1)
    each = [np.sort(rng.choice(len(index.terms), rng.integers(0, 25), replace=False)) for _ in range(600)]
    doc, term = np.repeat(np.arange(600), [len(t) for t in each]), np.concatenate(each)
    q = index.vectors(doc, term, rng.integers(1, 4, len(term)), 600)
    found, cosine = index.nearest(doc, term, q, 600, 7)
    for i, terms in enumerate(each):
        brute = dense[:, terms] @ q[doc == i]
        top = np.lexsort((np.arange(len(brute)), -brute.round(12)))[:7]
        assert np.allclose(cosine[i], np.where(brute[top] > 0, brute[top], 0))
        assert np.array_equal(found[i] >= 0, brute[top] > 0)
    assert 0 < len(index.matrix) < len(index.terms)


def test_every_term_is_indexed(spark, rows):
    """All words of the examples, of both labels, are terms; document frequencies count every document."""
    docs, index = fitted(spark, rows)
    learned = [t for i, t in rows[0] if i % 5]
    assert len(index.terms) == len({w.strip("!,") for t in learned for w in t.split()})
    assert np.allclose((dense_of(index) ** 2).sum(axis=1), 1)
    plain = T.fit(docs, spark.createDataFrame([x for x in rows[1] if x[0] % 5], "doc_id long, toxic int"), relevance=0.0)
    doc, term, _ = T.bags(T.pa.array([t for _, t in rows[0]], T.pa.large_string()), plain.terms)
    df = np.bincount(term, minlength=len(plain.terms))
    assert np.allclose(plain.factor, np.log((1 + len(rows[0])) / (1 + df)) + 1)
    got = T.score(docs, index).collect()
    assert all(r.evidence for r in got)  # each shares a word with an example


def test_ties_and_copies(spark):
    """Equal bags are one example with their mean label; equal cosines go by example."""
    docs = [(i, "same words here") for i in range(6)] + [(9, "other text"), (10, "vile text")]
    labels = [(i, int(i < 3)) for i in range(6)] + [(9, 0), (10, 1)]
    index = T.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sorted(index.ids) == [0, 9, 10]
    got = T.score(spark.createDataFrame([(1, "text"), (1, "text")], "doc_id long, text string"), index).collect()
    assert got[0] == got[1] and len(got[0].evidence) == 2


def test_odd_rows(spark, rows):
    docs, index = fitted(spark, rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (3, "  "), (4, "vilest " * 5000), (None, "x")], "doc_id long, text string")
    got = T.score(odd, index).collect()
    assert len(got) == 6 and [r.predicted for r in got if r.doc_id == 4] == [1]
    assert T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert {r.predicted for r in T.score(odd, None).collect()} == {0}
    assert T.score(docs.limit(0), index).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 as toxic", "2 as score", "3 as terms", "4 as evidence")
    assert T.score(clash, index).count() == docs.count() and T.keep_clean(clash, index).columns == clash.columns
    mixed = spark.createDataFrame([(None, 1), (1, None), (2, 7), (5, 1), (5, 0), (10**9, 1), (7, 0)], "doc_id long, toxic int")
    assert sorted(T.fit(docs, mixed).ids) == [5, 7]
