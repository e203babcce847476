"""Against a direct version, and the guarantee for shared passages."""

import hashlib
import random
import re

import pytest
import xxhash

from recordflow.llm import winnow as N

K, WINDOW = 5, 16


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def direct(text):
    """Hashes rolled word by word over the text, and every window's minimum, the rightmost of equal ones."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in words]
    if not h:
        return []
    if len(h) < K:
        g = [signed(xxhash.xxh64_intdigest(" ".join(map(str, h)).encode(), seed=42))]
    else:
        turn = lambda x, by: ((x << by) | (x >> (64 - by))) & (2**64 - 1)
        now, g = 0, []
        for i, x in enumerate(h):
            now = turn(now, 1) ^ (x & (2**64 - 1))
            if i >= K:
                now ^= turn(h[i - K] & (2**64 - 1), K)
            if i >= K - 1:
                g.append(signed(now))
    out = []
    for s in range(max(1, len(g) - WINDOW + 1)):
        window = range(s, min(len(g), s + WINDOW))
        best = min(window, key=lambda p: (g[p], -p))
        if (best, g[best]) not in out:
            out.append((best, g[best]))
    return out


def rows_of(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(50)] + ["é", "汉字"]
    rows = [(i * 7, " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 3, 5, 20, 21, 150))))) for i in range(70)]
    return [*rows, (1000, None), (1001, ""), (1002, "a b"), (1002, "a b"), (1003, "same " * 500), (1004, " \n " + rows[3][1])]


@pytest.mark.parametrize("size", [1, 9, 1000])
def test_against_direct(spark, monkeypatch, size):
    monkeypatch.setattr(N, "RANGE_ROWS", size)
    rows = rows_of(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in N.compare_fingerprints(docs.selectExpr("*", "1 as fp", "2 as edited")).collect():
        got.setdefault(r.doc_id, []).append(r)
    order = sorted(rows, key=lambda x: x[0])
    assert sum(map(len, got.values())) == len(rows)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, following = direct(text), direct(edited), direct(after)
        shown = lambda f: ",".join(f"{p}:{h & (2**64 - 1):X}" for p, h in f)

        def like(a, b):
            a, b = {h for _, h in a}, {h for _, h in b}
            return len(a & b) / len(a | b) if a | b else 1.0

        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(changed), like(own, changed), like(own, following))
        assert want in [tuple(r)[1:] for r in got[i]], i


def test_shared_passages_meet(spark):
    rng = random.Random(3)
    rows = []
    for i in range(30):
        shared = [f"s{i}_{k}" for k in range(WINDOW + K - 1)]
        for part in (0, 1):
            pad = lambda: [f"r{rng.random()}" for _ in range(rng.randint(0, 60))]
            rows.append((2 * i + part, " ".join(pad() + shared + pad())))
    df = N.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "text", "fp")
    sets = {r.doc_id: set(r.fp) for r in df.collect()}
    assert all(sets[2 * i] & sets[2 * i + 1] for i in range(30))


def test_small_tables(spark):
    assert N.compare_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (r,) = N.compare_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0
