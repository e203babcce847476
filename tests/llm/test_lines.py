"""Lines that go against a direct version, with full and overfull filters and both ways of telling the documents."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from recordflow.llm import lines as L

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def direct(docs, least, least_docs):
    """Of each row: text without repeated lines, lines, and lines dropped; a row is a document."""
    holders = defaultdict(list)
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                holders[k].append(i)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= least_docs}
    out = []
    for i, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if key(x) not in keeper or keeper[key(x)] in (None, i)]
        out.append((i, None if text is None else "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    pool = [f"Zeile {k} é" + "x" * rng.randint(0, 12) for k in range(40)]
    shared = [pool[k] for k in (0, 0, 0, 1, 1, 2, 3, 4, 5, 6)]
    docs = []
    for i in range(160):
        ls = [rng.choice((rng.choice(shared), f"line {rng.random()}", "", rng.choice(pool).upper(), " \t" + rng.choice(shared) + "\r", " " + shared[0])) for _ in range(rng.randint(0, 14))]
        docs.append((i * 2, "\n".join(ls)))
    docs += [(None, "\n".join(shared)), (None, None), (900, None), (901, ""), (902, "\n\n"), (903, "x"), (4, docs[2][1]), (4, docs[2][1])]
    docs += [(None, "only without an id here") for _ in range(4)] + [(904 + k, f"{shared[k % 3]}\n" * 4000) for k in range(3)]
    return docs


@pytest.mark.parametrize("options", [{}, {"folded": 1 << 10}, {"held": 3}, {"held": 3, "folded": 1 << 10}])
@pytest.mark.parametrize("least_docs", [3, 1])
def test_against_direct(spark, monkeypatch, options, least_docs):
    monkeypatch.setattr(L, "SEGMENT", 1 << 9)
    monkeypatch.setattr(L, "WAITING", 50 if options else L.WAITING)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_lines", "'d' as drops", "'k' as digest", "doc_id as _id", "array(doc_id) as sig").repartition(5)
    out = L.drop_repeated_lines(df, least_chars=10, least_docs=least_docs, **options)
    assert out.columns == ["doc_id", "text", "drops", "digest", "_id", "sig", "n_lines", "n_dropped"]
    rows = out.collect()
    assert all(r._id == r.doc_id and r.sig == [r.doc_id] and r.drops == "d" for r in rows)
    want = direct(docs, 10, least_docs)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows), key=repr) == want
    assert sum(w[3] for w in want) > 300


def test_first_filter_forgets_nothing(spark):
    """Every line of two documents is a suspect; lines of one are, seldom."""
    docs = [(i, "\n".join(f"a line of its own, number {i * 50 + k}" for k in range(50)) + f"\nshared by two documents {i // 2}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    bits = spark.sparkContext.broadcast(L.seen_twice(df, 10, L.cells_for(df, 10)))
    found = L.repeated_lines(df, bits, 10, 1).collect()
    assert sum(r.n == 2 for r in found) == 100 and sum(r.n == 1 for r in found) < 200
    assert {r.keeper for r in found if r.n == 2} == set(range(1, 200, 2))


def test_small_tables(spark):
    assert L.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (r,) = L.drop_repeated_lines(spark.createDataFrame([(None, None)], "doc_id long, text string")).select("n_lines", "n_dropped", F.col("text").isNull().alias("none")).collect()
    assert tuple(r) == (1, 0, True)
