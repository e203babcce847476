"""Connected components of an undirected graph, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, drop


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a long, b long) links -> (id long, root long), root the smallest reachable id.

    Ids that occur in no link are not listed.  Nulls, loops and repeated links
    are ignored; no links give no rows.  Each round turns every neighbourhood
    into links to its smallest member, first for larger neighbours and then for
    smaller ones; the forest that is left when nothing changes has depth one.
    Hubs are never gathered: both steps are a min (combined before the shuffle)
    and an equi-join, whose large keys adaptive execution can split.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        name,
    )
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        nxt = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        nxt = cut(nxt, name)
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        drop(now)
        now = nxt
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
