"""Ragged JSON: one VARIANT column, paths read where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dynamic(df: DataFrame, column: str) -> DataFrame:
    """The text column parsed as VARIANT in column ``value``; text that is no JSON is dropped."""
    return df.withColumn("value", F.try_parse_json(column)).where("value is not null")


def get(path: str, kind: str = "string", column: str = "value") -> Column:
    """A path's value as a type; null where it is missing or of another kind."""
    return F.try_variant_get(F.col(column), path, kind)


def type_of(path: str = "$", column: str = "value") -> Column:
    """The language's type name of a path's value; null if missing."""
    v = F.try_variant_get(F.col(column), path, "variant")
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.is_variant_null(v), "null")
        .when(t.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), "number")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def keys(text: str) -> Column:
    """Keys of an object in the order they are written, from its JSON text."""
    return F.json_object_keys(text)
