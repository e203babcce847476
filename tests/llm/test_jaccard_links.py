"""The join returns every link, against a direct comparison of all pairs; components are those of the links."""

import random

import pytest

from recordflow.llm import jaccard as J


def texts() -> list[tuple[int | None, str | None]]:
    rng, out = random.Random(5), []
    for g in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(160)]
        for _ in range(7):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(5000)}"
            out.append((len(out), " ".join(own)))
        out.append((len(out), out[-1][1].upper()))
    out += [(out[0][0], out[9][1]), (out[3][0], out[3][1]), (None, out[0][1]), (len(out), ""), (len(out) + 1, None), (len(out) + 2, "a b")]
    return out


def direct(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("block", [2048, 4])
def test_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = texts()
    sets = [direct(t) if i is not None else frozenset() for i, t in rows]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    want = sorted((str(i), len(direct(t)), sum(near(sets[n], s) for m, s in enumerate(sets) if m != n)) for n, (i, t) in enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in J.link_counts(docs).collect()) == want
    links, members = J.jaccard_join(docs)
    classes = {s for s in sets if s}
    pairs = [(a, b) for a in classes for b in classes if a != b and near(a, b)]
    got = links.collect()
    assert len(got) == len({(r.a, r.b) for r in got}) == len(pairs) // 2 > len(classes)
    assert sorted((min(r.n_a, r.n_b), max(r.n_a, r.n_b), r.n_common) for r in got) == sorted((min(len(a), len(b)), max(len(a), len(b)), len(a & b)) for a, b in pairs)[::2]
    assert members.count() == len(rows)
