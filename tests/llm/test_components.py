"""Components against a search, on chains, stars, cycles and odd links."""

import random

from recordflow.llm.components import components


def test_against_a_search(spark):
    rng = random.Random(8)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(k, 600 + (k - 599) % 20) for k in range(600, 620)]
    links += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)] + [(7, 7), (None, 3), (3, None), (100, 101), (101, 100)]
    near = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            if (at := todo.pop()) not in want:
                want[at] = start
                todo += near[at]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(want) and {r.id: r.root for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
