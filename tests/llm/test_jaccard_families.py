"""Families that a common passage joins are parted before they are compared."""

import random

from pyspark.sql import functions as F

from recordflow.llm import jaccard as J

from .test_jaccard import components, run
from .test_jaccard import test_bands_and_blocks as bands_and_blocks
from .test_jaccard_links import test_every_link as every_link


def test_a_common_passage_joins_no_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "COMMON", 1e9)  # as where a passage is too rare among all shingles to be known as common
    dealt = []
    links = J.block_links

    def counted(members, *rest, **named):
        dealt.append(members.agg(F.sum("blocks")).first()[0])
        return links(members, *rest, **named)

    monkeypatch.setattr(J, "block_links", counted)
    rng = random.Random(6)
    passage = [f"p{v}" for v in range(50)]
    rows = []
    for d in range(60):
        words = [*passage, *(f"w{rng.randrange(10**6)}" for _ in range(50))]
        rows.append((len(rows), " ".join(words)))
        if d % 10 == 0:
            rows.append((len(rows), " ".join([*words, "tail"])))
    rows += [(rows[3][0], " ".join(rng.choices(passage, k=40))), (rows[3][0], rows[3][1] + " end"), (rows[8][0], rows[8][1])]
    assert run(spark, rows) == components(rows)
    assert dealt and dealt[0] <= 16  # 6 pairs, and the sets of the doc_id that has several


def test_parted_families_keep_every_link(spark, monkeypatch):
    every_link(spark, monkeypatch, 2)
    bands_and_blocks(spark, monkeypatch, 1, 16 << 20)
