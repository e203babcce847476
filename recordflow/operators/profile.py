"""analyze and inspect: one pass over the stream, a row for each field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import kind


def analyze(df: DataFrame, sample: int | None = None) -> DataFrame:
    """field, count (values that are not null), frequency, type, and for numbers min, max, sum and mean.

    One aggregation with partial sums; its single row is then turned into a row
    for each field.  sample: only so many records.
    """
    src = df.limit(sample) if sample else df
    aggs = [F.count(F.lit(1)).alias("_n")]
    numeric = []
    for i, f in enumerate(src.schema):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"c{i}"))
        numeric.append(isinstance(f.dataType, T.NumericType))
        if numeric[-1]:
            d = c.cast("double")
            aggs += [F.min(d).alias(f"lo{i}"), F.max(d).alias(f"hi{i}"), F.sum(d).alias(f"s{i}"), F.avg(d).alias(f"m{i}")]
    none = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(f.name).alias("field"),
            F.lit(kind(f.dataType)).alias("type"),
            F.col(f"c{i}").alias("count"),
            F.try_divide(F.col(f"c{i}") * 100.0, F.col("_n")).alias("frequency"),
            *((F.col(f"{p}{i}") if numeric[i] else none).alias(n) for p, n in (("lo", "min"), ("hi", "max"), ("s", "sum"), ("m", "mean"))),
        )
        for i, f in enumerate(src.schema)
    ]
    return src.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def inspect_schema(df: DataFrame, sample: int = 100, samples: int = 3) -> DataFrame:
    """field, type, nullable (a null was seen), count, and up to three sample values as text: one that was met, the least and the largest.

    sample: records looked at, 0 for all.
    """
    src = df.limit(sample) if sample else df
    aggs = []
    for i, f in enumerate(src.schema):
        c = F.col(f"`{f.name}`")
        text = c.cast("string") if isinstance(f.dataType, T.AtomicType) else F.to_json(c) if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType) else c.cast("string")
        aggs += [F.count(c).alias(f"c{i}"), F.count_if(c.isNull()).alias(f"n{i}")]
        lowest = F.min(text)
        aggs += [lowest.alias(f"a{i}"), F.max(text).alias(f"b{i}"), F.first(text, ignorenulls=True).alias(f"f{i}")]
    rows = [
        F.struct(
            F.lit(f.name).alias("field"),
            F.lit(kind(f.dataType)).alias("type"),
            (F.col(f"n{i}") > 0).alias("nullable"),
            F.col(f"c{i}").alias("count"),
            F.slice(F.array_distinct(F.transform(F.filter(F.array(f"f{i}", f"a{i}", f"b{i}"), lambda x: x.isNotNull()), lambda x: F.substring(x, 1, 50))), 1, samples).alias("samples"),
        )
        for i, f in enumerate(src.schema)
    ]
    return src.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
