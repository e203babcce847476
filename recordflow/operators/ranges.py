"""Ranges of about equal size over any orderable key, told by bounds from a sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows looked at for each bound.
SAMPLES = 20

_SPAN = 1 << 40


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, but for maps, which have none."""
    return F.xxhash64(*(f"`{f.name}`" for f in df.schema if "map<" not in f.dataType.simpleString()))


def _literal(value, kind: T.DataType) -> Column:
    """A collected value as a column of its type."""
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*(_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind, strict=True)))
    if isinstance(kind, T.ArrayType) and value is not None:
        return F.array(*(_literal(v, kind.elementType) for v in value)).cast(kind)
    return F.lit(value).cast(kind)


def _leaves(key: Column, kind: T.DataType) -> list[tuple[Column, T.DataType]]:
    """The fields of a key, those of inner structs instead of these, in order."""
    if not isinstance(kind, T.StructType):
        return [(key, kind)]
    return [leaf for f in kind for leaf in _leaves(key.getField(f.name), f.dataType)]


def _number(value: Column, kind: T.DataType) -> Column | None:
    """A number in the order of value (null for null), None if its type has none."""
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return value.cast("long")
    if isinstance(kind, T.FloatType | T.DoubleType):
        return value.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampNTZType):
        seconds = (F.unix_date(value.cast("date")).cast("long") * 24 + F.hour(value)) * 3600 + F.minute(value) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("long")
    return None


class Bounds(list):
    """Rows of bounds in order, and their type.  Where all their fields are numbers or times there is an array of each field:
    a plan with an expression for each bound takes longer to plan than to run."""

    def __init__(self, rows: list, kind: T.StructType, arrays: list[Column] | None):
        super().__init__(rows)
        self.kind, self.arrays = kind, arrays


def cuts(keys: DataFrame, most: int, rows: int) -> Bounds:
    """Bounds that cut keys (a struct column k and its hash h) into at most `most` ranges of about `rows` rows.

    The sample is of different keys by hash, so its size is bounded and it is the same in every run.
    """
    kind = keys.schema["k"].dataType
    total = keys.count()
    n = min(most, total // rows)
    if n < 2:
        return Bounds([], kind, None)
    share = min(_SPAN, int(n * SAMPLES / total * _SPAN))
    leaves = [_number(*leaf) for leaf in _leaves(F.col("k"), kind)]
    plain = all(x is not None for x in leaves)
    shown = [x.alias(f"n{i}") for i, x in enumerate(leaves)] if plain else [F.col("k.*")]
    seen = keys.where(F.pmod("h", F.lit(_SPAN)) < share).select("k").distinct().orderBy("k").select(*shown)
    found = seen.collect()
    picked = list(dict.fromkeys(found[i * len(found) // n] for i in range(1, n))) if found else []
    if plain and picked and not any(v is None for r in picked for v in r):
        return Bounds(picked, kind, [F.lit(np.array(v, np.float64 if isinstance(v[0], float) else np.int64)) for v in zip(*picked, strict=True)])
    if plain and picked:
        found = keys.where(F.pmod("h", F.lit(_SPAN)) < share).select("k").distinct().orderBy("k").select("k.*").collect()
        picked = list(dict.fromkeys(found[i * len(found) // n] for i in range(1, n)))
    return Bounds(picked, kind, None)


def place(key: Column, bounds: Bounds) -> Column:
    """How many bounds are below the key, by halving; nulls are below all else."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*(F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1)))
    if bounds.arrays is None:
        known = F.array(*(_literal(r, bounds.kind) for r in bounds))
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(known, at + step - 1) < key, F.lit(False)), at + step).otherwise(at))
    own = [_number(*leaf).alias(f"n{i}") for i, leaf in enumerate(_leaves(key, bounds.kind))]

    def halve(state: Column, step: Column) -> Column:
        at, less = state["at"] + step - 1, F.lit(False)
        for i, known in reversed(list(enumerate(bounds.arrays))):
            bound, k = F.get(known, at), state[f"n{i}"]
            less = F.coalesce(bound < k, F.lit(False)) | (F.coalesce(bound == k, F.lit(False)) & less)
        return F.struct(F.when(less, state["at"] + step).otherwise(state["at"]).alias("at"), *(state[f"n{i}"].alias(f"n{i}") for i in range(len(own))))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), *own), halve, lambda state: state["at"])
