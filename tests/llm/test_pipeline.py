"""The stages one by one against direct versions, on a small corpus."""

import random

import pytest

import corpus_pipeline as P
from tests.llm.test_secretscan import slow_base
from tests.llm.test_substring import direct


def shingles(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"v{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 120))] for _ in range(160)]
    shared = [rng.choice(words) for _ in range(40)]
    rows = []
    for i, ws in enumerate(base):
        ws = list(ws)
        if i % 8 == 0:
            ws[3] = rng.choice(("vilest", "rotten", "horrid"))
        if i % 10 == 1:
            ws[5:5] = shared
        if i % 9 == 2:
            ws.insert(4, f'token = "{rng.randbytes(20).hex()}"')
        rows.append((i, " ".join(ws), "en", "s", 0))
        if i % 12 == 3:
            ws[7] = "edited"
            rows.append((1000 + i, " ".join(ws), "en", "s", 0))
    rows += [(2000, None, "en", "s", None), (2001, "", None, "s", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(160)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    out = dict(P.STAGES)["toxicity"](spark, docs, corpus)
    assert out.columns == columns
    kept = {r.doc_id: r.text for r in out.collect()}
    assert set(before) - set(kept) == {i for i in range(0, 160, 8)}

    docs = spark.createDataFrame(out.collect(), docs.schema)
    out = dict(P.STAGES)["near_copies"](spark, docs, corpus)
    sets = {i: shingles(t) for i, t in kept.items()}
    gone = {j for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    rows = out.collect()
    assert out.columns == columns and {r.doc_id for r in rows} == set(kept) - gone and gone

    docs = spark.createDataFrame(rows, docs.schema)
    out = dict(P.STAGES)["repeated_passages"](spark, docs, corpus)
    want = direct([(r.doc_id, r.text) for r in rows], 20)
    new = {r.doc_id: r for r in out.collect()}
    assert out.columns == columns and any(w[1] for w in want.values())
    for r in rows:
        assert len((new[r.doc_id].text or "").split()) == want[r.doc_id][0] - want[r.doc_id][1]

    docs = spark.createDataFrame(list(new.values()), docs.schema)
    out = dict(P.STAGES)["secrets"](spark, docs, corpus)
    clean = {r.doc_id: r for r in out.collect()}
    assert out.columns == columns and set(clean) == set(new)
    for i, r in clean.items():
        assert not slow_base(r.text or "") and r.n_chars == (None if r.text is None else len(r.text))
        if not slow_base(new[i].text or ""):
            assert r.text == new[i].text

    packed = dict(P.STAGES)["packing"](spark, spark.createDataFrame(list(clean.values()), docs.schema), corpus).collect()
    assert {r.doc_id for r in packed} == set(clean)
    whole = P.run(spark, corpus).collect()
    key = lambda rs: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert key(whole) == key(packed)


def test_nothing_and_odd_rows(spark, corpus, tmp_path):
    """An empty table gives an empty one; nulls in every column, empty and repeated rows and clashing columns go through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, sig string, spans string"
    for name, rows in (("none", []), ("odd", [(None,) * 9, (None,) * 9, (1, "", *[None] * 7), (1, "", *["x"] * 2, 0, *["y"] * 4), (2, "some words here " * 3000, *[None] * 7), (3, "a b c d e f g", *[None] * 7), (4, "a b c d e f g", *[None] * 7)])):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
        spark.read.parquet(f"{corpus}/labels.parquet").where("doc_id > 4" if rows else "true").write.parquet(f"{path}/labels.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert docs.count() == (0 if not rows else 6 if docs.where("doc_id = 1").count() == 2 else 5)
        assert {r.doc_id for r in P.run(spark, path).collect()} == ({None, 1, 2, 3} if rows else set())
