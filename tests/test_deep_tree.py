"""Trees of any depth in few rounds; cycles end; nested roots and several parents."""

import random

import pytest

from recordflow import tasks


def direct(links, roots):
    """By walking down from each root."""
    below = {}
    for child, up in links:
        if up is not None:
            below.setdefault(up, []).append(child)
    out = {}
    for root in roots:
        level, d = [root], 0
        while level:
            for x in level:
                out.setdefault((root, x), d)
            level, d = [c for x in level for c in below.get(x, []) if (root, c) not in out], d + 1
    return out


def found(df):
    rows = df.collect()
    assert len({(r.root, r.id) for r in rows}) == len(rows)
    return {(r.root, r.id): r.depth for r in rows}


def test_tree_deep_and_cyclic(spark):
    chain = [(k, k - 1 if k else None) for k in range(70)] + [(100, 102), (101, 100), (102, 101)]
    t = spark.createDataFrame(chain, "id long, parent long")
    got = found(tasks.tree(t, t.where("id in (0, 100)")))
    assert got == {(0, k): k for k in range(70)} | {(100, 100): 0, (100, 101): 1, (100, 102): 2}
    assert found(tasks.tree(t, t.where("id = 0"), depth=3)) == {(0, k): k for k in range(4)}


def test_ten_thousand_levels(spark, monkeypatch):
    written = []
    real = tasks._written
    monkeypatch.setattr(tasks, "_written", lambda df, folder, name: written.append(name) or real(df, folder, name))
    t = spark.range(10_001).selectExpr("id", "case when id > 0 then id - 1 end as parent")
    got = tasks.tree(t, t.where("id = 0"))
    assert got.selectExpr("count(*)", "max(depth)", "count_if(depth = id)").first() == (10_001, 10_000, 10_001)
    assert len([w for w in written if not w.startswith("over")]) <= 16


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    links = [(i, rng.choice([None, *range(60)])) for i in range(60)]  # cycles are likely
    roots = rng.sample(range(60), 9) + [999]
    t = spark.createDataFrame(links, "id int, parent int")
    r = spark.createDataFrame([(x,) for x in [*roots, roots[0], None]], "id int")
    assert found(tasks.tree(t, r)) == direct(links, roots)
    several = links + [(i, rng.randrange(60)) for i in range(0, 60, 7)]
    assert found(tasks.tree(spark.createDataFrame(several, "id int, parent int"), r.where("id is not null"))) == direct(several, roots)
