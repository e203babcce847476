"""Components against a direct comparison of all pairs: short sets, similarities of exactly 80 %, several bands, blocks, odd rows."""

import random

import numpy as np
import pytest

from recordflow.llm import jaccard as J

from .test_jaccard_links import direct


def components(rows):
    """The class of every row by comparing all pairs; rows of one doc_id are one node."""
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    known = [(i, direct(t)) for i, t in rows if i is not None]
    for n, (i, a) in enumerate(known):
        for j, b in known[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((str(i), len(direct(t)), str(find(i)) if i is not None else "None") for i, t in rows)


def run(spark, rows, extra="1 as sig"):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.jaccard_components(docs.selectExpr("*", extra, "2 as keys", "3 as n", "4 as root")).collect())


def of_sets(sets):
    """Texts whose shingle sets are as large and overlap as the sets of numbers given: a shingle is 5 words of its own... or a run."""
    return [" ".join(f"s{v}" for v in s) for s in sets]


def test_short_texts(spark):
    """Sets of 1 to 12 shingles, with partners one word longer or shorter."""
    rng = random.Random(1)
    rows = []
    for n in range(1, 17):
        for _ in range(6):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words, "tail"])), (len(rows) + 2, " ".join(words[1:]))]
    assert run(spark, rows) == components(rows)


def test_exactly_eighty_percent(spark):
    """k shingles in common of 10 k / 8 in all, and one short of it."""
    rows = []
    for common in (4, 8, 40, 400):
        for short in (0, 1):
            words = [f"c{common}x{short}x{v}" for v in range(common + 4)]
            for side in range(2):
                extra = common // 4 // 2 + (common // 4 % 2 if side else 0) + (short if side else 0)
                rows.append((len(rows), " ".join([*words, *(f"e{common}x{short}x{side}x{v}" for v in range(extra))])))
    got = run(spark, rows)
    assert got == components(rows)
    assert len({c for _, _, c in got}) == len(rows) - 4  # those of exactly 80 % link, the others don't


@pytest.mark.parametrize("block,size", [(2048, 16 << 20), (4, 16 << 20), (2048, 4000)])
def test_bands_and_blocks(spark, monkeypatch, block, size):
    """Chains of edited copies over sizes that cross bands, in blocks bounded by rows and by bytes."""
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "BLOCK_BYTES", size)
    rng = random.Random(2)
    rows = []
    for n in (20, 27, 80, 81, 82, 240, 250, 730):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(6):
            rows.append((len(rows), " ".join(words)))
            words = [*words[: int(len(words) * 0.93)], *(f"n{rng.randrange(10**6)}" for _ in range(int(len(words) * rng.uniform(0, 0.14))))]
    rng.shuffle(rows)
    assert run(spark, rows) == components(rows)


def test_odd_rows(spark):
    long = "very long " * 20_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d e f"), (4, "A b C d E f"), (5, "a b c d e f"), (5, "other words of the same id here"), (6, "other WORDS of the same id here"), (7, "a b c"), (8, "a b c"), (9, long), (10, long + "x"), (11, "a b c d e f"), (11, "a b c d e f")]
    assert run(spark, rows) == components(rows)
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one(spark):
    """Every text that links with nothing earlier stays, one row each, with all columns; so do nulls and rows without an id."""
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z"), (3, None, "z"), (None, "a b c d e f", "w"), (4, "", "v"), (5, "p q r s t u", "s"), (5, "one two three four five six", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    assert sorted(map(str, map(tuple, J.keep_one(docs).collect()))) == sorted(map(str, [rows[0], rows[2], rows[4], rows[5], rows[6], rows[7]]))
    assert J.keep_one(docs.limit(0)).count() == 0


def test_small_sets_meet_by_content():
    """Random unrelated small sets share no key, so their families don't grow with the corpus; linked ones do share one."""
    rng = np.random.default_rng(4)
    common = np.zeros(1 << J.COUNTER_BITS, bool)
    for n in (1, 2, 3, 4, 5, 6, 7, 9, 12):
        seen, most = {}, 0
        for _ in range(4000):
            s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            for key in J._keys(s, n, 80, common).tolist():
                seen[key] = seen.get(key, 0) + 1
                most = max(most, seen[key])
            if n > 3:
                for other in (np.append(s, rng.integers(0, 2**63, n // 4).astype(np.uint64)), s[: -(-n * 4 // 5)]):
                    assert set(J._keys(s, n, 80, common).tolist()) & set(J._keys(np.unique(other), len(other), 80, common).tolist())
        assert most <= 2
