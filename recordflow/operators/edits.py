"""Field edits: set, delete, merge, append, prepend, in the order given."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path(text: str) -> list[str | int]:
    """.a.b[2] as names and array places."""
    out: list[str | int] = []
    for name, at in re.findall(r"\.?([A-Za-z_][\w-]*)|\[(\d+)\]", text):
        out.append(int(at) if at else name)
    if not out:
        raise ValueError(f"not a path: {text!r}")
    return out


def literal(value: object) -> Column:
    """A JSON value as a column."""
    if isinstance(value, dict):
        return F.struct(*(literal(v).alias(k) for k, v in value.items()))
    if isinstance(value, list):
        return F.array(*(literal(v) for v in value)) if value else F.array().cast("array<string>")
    return F.lit(value).cast("long") if isinstance(value, int) and not isinstance(value, bool) else F.lit(value)


def parsed(text: str) -> object:
    """JSON, or the text itself if it is none."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def _set(col: Column | None, kind: T.DataType | None, at: list[str | int], new) -> Column:
    """col with new(old value) at a path; objects on the way are made, arrays are filled up with nulls."""
    if not at:
        return new(col, kind)
    step, rest = at[0], at[1:]
    if isinstance(step, int):
        element = kind.elementType if isinstance(kind, T.ArrayType) else None
        old = F.coalesce(col, F.array().cast(kind)) if element is not None else None
        value = _set(F.get(old, F.lit(step)) if old is not None else None, element, rest, new)
        if old is None:
            return F.concat(F.array_repeat(F.lit(None), step), F.array(value)) if step else F.array(value)
        value = value.cast(element)
        longer = F.concat(old, F.array_repeat(F.lit(None).cast(element), F.greatest(F.lit(step + 1) - F.size(old), F.lit(0))))
        return F.transform(longer, lambda x, i: F.when(i == step, value).otherwise(x))
    fields = kind.names if isinstance(kind, T.StructType) else []
    inner = _set(col.getField(step) if step in fields else None, kind[step].dataType if step in fields else None, rest, new)
    kept = [col.getField(n).alias(n) if n != step else inner.alias(n) for n in fields]
    return F.struct(*kept, *([] if step in fields else [inner.alias(step)]))


def _change(df: DataFrame, at: list[str | int], new) -> DataFrame:
    name, rest = str(at[0]), at[1:]
    there = name in df.columns
    return df.withColumn(name, _set(F.col(f"`{name}`") if there else None, df.schema[name].dataType if there else None, rest, new))


def delete(df: DataFrame, at: list[str | int]) -> DataFrame:
    """df without a field; a missing one changes nothing."""
    name = str(at[0])
    if name not in df.columns:
        return df
    if len(at) == 1:
        return df.drop(name)
    kind: T.DataType = df.schema[name].dataType
    for step in at[1:]:
        if not isinstance(kind, T.StructType) or step not in kind.names:
            return df
        kind = kind[step].dataType
    return df.withColumn(name, F.col(f"`{name}`").dropFields(".".join(f"`{s}`" for s in at[1:])))


def merge_objects(df: DataFrame, value: dict, base: tuple[str, ...] = ()) -> DataFrame:
    """Deep merge of an object into every record; null sets null."""
    for k, v in value.items():
        at = [*base, k]
        df = merge_objects(df, v, tuple(at)) if isinstance(v, dict) and v else _change(df, at, lambda _, __, v=v: literal(v))
    return df


def _added(value: Column, front: bool):
    def make(old: Column | None, kind: T.DataType | None) -> Column:
        if old is None:
            return F.array(value)
        if isinstance(kind, T.ArrayType):
            both = [F.coalesce(old, F.array().cast(kind)), F.array(value.cast(kind.elementType))]
        else:  # a single value becomes the first element
            both = [F.when(old.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(old)), F.array(value.cast(kind))]
        return F.concat(*(reversed(both) if front else both))

    return make


def edit(df: DataFrame, *edits: str, merge: dict | str | None = None) -> DataFrame:
    """Edits every record.

    ``.p=text`` sets a string, ``.p:=json`` a JSON value (text if it is none),
    ``-.p`` deletes, ``.p+=json`` appends, ``.p^=json`` prepends.  merge is applied first.
    """
    if merge is not None:
        df = merge_objects(df, json.loads(merge) if isinstance(merge, str) else merge)
    for e in edits:
        if e.startswith("-"):
            df = delete(df, path(e[1:]))
            continue
        m = re.match(r"((?:\.?[A-Za-z_][\w-]*|\[\d+\])+)(:=|\+=|\^=|=)(.*)\Z", e, re.S)
        if not m:
            raise ValueError(f"not an edit: {e!r}")
        at, op, text = path(m[1]), m[2], m[3]
        if op in ("=", ":="):
            value = text if op == "=" else parsed(text)
            df = _change(df, at, lambda _, __, value=value: literal(value))
        else:
            df = _change(df, at, _added(literal(parsed(text)), op == "^="))
    return df
