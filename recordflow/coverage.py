"""Coverage roll-ups over the facts of an LCOV report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _share(hit, all_):
    return F.round(F.try_divide(hit.cast("double"), all_), 4)


def files(facts: DataFrame) -> DataFrame:
    """file, lines, hit_lines, branches, hit_branches and their shares."""
    count = lambda kind, hit: F.count_if((F.col("kind") == kind) & (F.col("hits") > 0 if hit else F.lit(True)))
    out = facts.groupBy("file").agg(count("line", False).alias("lines"), count("line", True).alias("hit_lines"), count("branch", False).alias("branches"), count("branch", True).alias("hit_branches"))
    return out.withColumn("line_share", _share(F.col("hit_lines"), F.col("lines"))).withColumn("branch_share", _share(F.col("hit_branches"), F.col("branches")))


def functions(facts: DataFrame) -> DataFrame:
    """file, name, calls, lines and hit_lines of each function, by containment of lines; an open end reaches the next function."""
    from pyspark.sql import Window

    own = facts.where("kind = 'function'").select("file", "name", F.col("line").alias("start"), "end", F.col("hits").alias("calls"))
    following = F.lead("start").over(Window.partitionBy("file").orderBy("start"))
    own = own.withColumn("end", F.coalesce("end", following - 1, F.lit(2**31 - 1)))
    lines = facts.where("kind = 'line'").select(F.col("file").alias("f"), "line", "hits")
    met = own.join(lines, (F.col("f") == F.col("file")) & F.col("line").between(F.col("start"), F.col("end")), "left")
    out = met.groupBy("file", "name", "start", "calls").agg(F.count("line").alias("lines"), F.count_if(F.col("hits") > 0).alias("hit_lines"))
    return out.withColumn("line_share", _share(F.col("hit_lines"), F.col("lines")))


def call_counts(calls: DataFrame) -> DataFrame:
    """callee -> callers, by full and by simple name, whichever is more."""
    full = calls.groupBy("callee").agg(F.count_distinct("caller").alias("full"))
    simple = calls.groupBy(F.element_at(F.split("callee", r"\."), -1).alias("simple")).agg(F.count_distinct("caller").alias("by_name"))
    named = full.withColumn("simple", F.element_at(F.split("callee", r"\."), -1))
    return named.join(simple, "simple", "left").select("callee", F.greatest("full", "by_name").alias("callers"))
