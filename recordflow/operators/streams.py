"""head, tail, numbers and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import cuts, place, row_hash


def head(df: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """The first n records; with order a top-k, without it any n, as a stream of files has no order of its own."""
    if n < 0:
        raise ValueError("n must not be negative")
    return (df.orderBy(*order) if order else df).limit(n)


def tail(df: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """The last n records by order, in that order; a descending top-k and not a sort of the whole stream."""
    if n < 0:
        raise ValueError("n must not be negative")
    if not order:
        raise ValueError("the last records need an order; load with lineage and use its columns")
    return df.orderBy(*(F.col(c).desc_nulls_last() for c in order)).limit(n).orderBy(*(F.col(c).asc_nulls_first() for c in order))


#: Rows of a range about, and ranges at most.
RANGE_ROWS, RANGES = 50_000, 1024


def numbered(df: DataFrame, order: list[str], name: str = "seq", start: int = 1, ranges: int = RANGES) -> DataFrame:
    """Adds gapless numbers from start by order; rows equal in it are ordered by a hash of the whole row.

    Rows are cut into ranges of all order columns and that hash, so neither texts with a
    common beginning nor a value that most rows share gather in one range; only rows
    that are equal in every column stay together.  Numbers are given within a range, which begins
    after the counts of those before.  nulls come first.
    """
    key = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(order)), row_hash(df).alias("h"))
    bounds = cuts(df.select(key.alias("k")).select("k", "k.h"), ranges, RANGE_ROWS)
    rows = df.select(key.alias("_key"), F.struct("*").alias("_row"))
    rows = rows.withColumn("_range", place(F.col("_key"), bounds))
    counts = rows.groupBy("_range").count()
    before = counts.select(F.col("_range").alias("_r"), (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*(F.col(f"_key.c{i}").asc_nulls_first() for i in range(len(order))), "_key.h"))
    out = rows.withColumn("_own", own).join(F.broadcast(before), F.col("_range") == F.col("_r"))
    return out.select("_row.*", (F.col("_before") + F.col("_own") + (start - 1)).cast("long").alias(name))


def merge(sources: list[tuple[str, DataFrame] | tuple[str, DataFrame, str]], lineage: bool = True, distinct: bool = False) -> DataFrame:
    """All records of all sources, or the different ones; with lineage also _source, and _label where a source has one.

    Columns are matched by name; a column that a source lacks is null there.
    """
    if not sources:
        raise ValueError("nothing to merge")
    labelled = any(len(s) > 2 for s in sources)
    parts = []
    for s in sources:
        df = s[1]
        if lineage:
            front = [F.lit(s[0]).alias("_source")] + ([F.lit(s[2] if len(s) > 2 else None).cast("string").alias("_label")] if labelled else [])
            df = df.select(*front, *(c for c in df.columns if c not in ("_source", "_label")))
        parts.append(df)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.distinct() if distinct else out
