"""Expression trees as columns and DataFrame stages, for records with known columns.

No value and null are one thing here, SQL's NULL: at top level a record without a
value is dropped, inside an object the field is null.  Types are resolved while
compiling, against the analysed plan, so a function on a wrong type becomes a
typed null and never an error at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import ExpressionError, parse
from ..expr import tree as N
from ..functions import FUNCTIONS, GENERATORS, STRINGS
from ..functions.registry import is_array, is_bool, is_number, is_object, is_string, is_whole, kind

#: Dates and times are ISO text in the language.
_COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")
_TEXT = (T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass(frozen=True)
class Val:
    """A compiled value: its column, and its type."""

    col: Column
    type: T.DataType


def _null() -> Val:
    return Val(F.lit(None), T.NullType())


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Compiler:
    """Compiles nodes over the columns of one DataFrame."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.spark = df.sparkSession

    def root(self) -> Val:
        return Val(F.struct(*(F.col(quoted(c)) for c in self.df.columns)), self.df.schema)

    def typed(self, make, *inputs: Val) -> Val:
        """make(columns), with the type that it has for inputs of these types."""
        base = self.spark.range(0).select(*(F.lit(None).cast(v.type).alias(f"c{i}") for i, v in enumerate(inputs)))
        out = make(*(F.col(f"c{i}") for i in range(len(inputs))))
        if out is None:
            return _null()
        return Val(make(*(v.col for v in inputs)), base.select(out.alias("x")).schema[0].dataType)

    # every node takes the value of ``.``; None: the record itself

    def compile(self, node: N.Node, cur: Val | None) -> Val:
        return getattr(self, f"_{type(node).__name__.lower()}")(node, cur)

    def _identity(self, node: N.Identity, cur: Val | None) -> Val:
        return self.root() if cur is None else cur

    def _field(self, node: N.Field, cur: Val | None) -> Val:
        if isinstance(node.base, N.Identity) and cur is None:
            if node.name not in self.df.columns:
                return _null()
            return self._plain(Val(F.col(quoted(node.name)), self.df.schema[node.name].dataType))
        base = self.compile(node.base, cur)
        if isinstance(base.type, T.StructType):
            return self._plain(Val(base.col.getField(node.name), base.type[node.name].dataType)) if node.name in base.type.names else _null()
        if isinstance(base.type, T.MapType):
            return Val(F.try_element_at(base.col, F.lit(node.name)), base.type.valueType)
        return _null()

    def _plain(self, v: Val) -> Val:
        if isinstance(v.type, T.DateType):
            return Val(F.date_format(v.col, "yyyy-MM-dd"), T.StringType())
        return Val(F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss"), T.StringType()) if isinstance(v.type, _TEXT) else v

    def _index(self, node: N.Index, cur: Val | None) -> Val:
        base = self.compile(node.base, cur)
        if not is_array(base.type):
            return _null()
        return Val(F.try_element_at(base.col, F.lit(node.at + 1 if node.at >= 0 else node.at)), base.type.elementType)

    def _slice(self, node: N.Slice, cur: Val | None) -> Val:
        base = self.compile(node.base, cur)
        if not is_array(base.type):
            return _null()
        n = F.size(base.col)
        place = lambda x, default: default if x is None else F.least(F.lit(x), n) if x >= 0 else F.greatest(n + x, F.lit(0))
        start, end = place(node.start, F.lit(0)), place(node.end, n)
        return Val(F.slice(base.col, start + 1, F.greatest(end - start, F.lit(0))), base.type)

    def _iterate(self, node: N.Iterate, cur: Val | None) -> Val:
        raise ExpressionError(".[] gives many values; use it as a stage of its own, or map() inside an expression")

    def _pipe(self, node: N.Pipe, cur: Val | None) -> Val:
        left = node.left
        if isinstance(left, N.Iterate):
            raise ExpressionError(".[] gives many values; use map()")
        if isinstance(left, N.Call) and left.name == "select":
            out = self.compile(node.right, cur)
            return Val(F.when(self.truth(left.args[0], cur), out.col), out.type)
        return self.compile(node.right, self.compile(left, cur))

    def _literal(self, node: N.Literal, cur: Val | None) -> Val:
        v = node.value
        t = T.NullType() if v is None else T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.StringType()
        return Val(F.lit(v).cast(t) if v is not None else F.lit(None), t)

    def truth(self, node: N.Node, cur: Val | None) -> Column:
        """A condition as true or false: null and false are false, all else true; nothing found is false."""
        if isinstance(node, N.Not):
            return ~self.truth(node.inner, cur)
        if isinstance(node, N.Binary) and node.op in ("and", "or"):
            a, b = self.truth(node.left, cur), self.truth(node.right, cur)
            return (a & b) if node.op == "and" else (a | b)
        v = self.compile(node, cur)
        if isinstance(v.type, T.NullType):
            return F.lit(False)
        return F.coalesce(v.col, F.lit(False)) if is_bool(v.type) else v.col.isNotNull()

    def _not(self, node: N.Not, cur: Val | None) -> Val:
        return Val(self.truth(node, cur), T.BooleanType())

    def _if(self, node: N.If, cur: Val | None) -> Val:
        a, b = self.compile(node.then, cur), self.compile(node.other, cur)
        a, b = self._alike(a, b)
        test = self.truth(node.test, cur)
        return Val(F.when(test, a.col).otherwise(b.col), a.type if not isinstance(a.type, T.NullType) else b.type)

    def _alike(self, a: Val, b: Val) -> tuple[Val, Val]:
        """Two values as one type: numbers widen, other mixtures become text."""
        if a.type == b.type or isinstance(a.type, T.NullType) or isinstance(b.type, T.NullType):
            return a, b
        if is_number(a.type) and is_number(b.type):
            t: T.DataType = T.LongType() if is_whole(a.type) and is_whole(b.type) else T.DoubleType()
            return Val(a.col.cast(t), t), Val(b.col.cast(t), t)
        text = lambda v: self.typed(lambda c: FUNCTIONS["tostring"](c, v.type), v) if not (is_array(v.type) or is_object(v.type)) else Val(F.to_json(v.col), T.StringType())
        return text(a), text(b)

    def _binary(self, node: N.Binary, cur: Val | None) -> Val:
        op = node.op
        if op in ("and", "or"):
            return Val(self.truth(node, cur), T.BooleanType())
        if op in _COMPARISONS:
            return Val(F.coalesce(self._compare(node, cur), F.lit(False)), T.BooleanType())
        a, b = self.compile(node.left, cur), self.compile(node.right, cur)
        if op == "//":
            a, b = self._alike(a, b)
            if isinstance(a.type, T.NullType):
                return b
            return Val(F.coalesce(F.when(a.col, a.col) if is_bool(a.type) else a.col, b.col), a.type)
        return self._arithmetic(op, a, b)

    def _compare(self, node: N.Binary, cur: Val | None) -> Column:
        """SQL's comparison, null where a side is not found; different types are unequal and not ordered."""
        op, a, b = node.op, self.compile(node.left, cur), self.compile(node.right, cur)
        null = [isinstance(x, N.Literal) and x.value is None for x in (node.left, node.right)]
        if any(null):
            other = b if null[0] else a
            there = F.lit(False) if all(null) or isinstance(other.type, T.NullType) else other.col.isNotNull()
            return ~there if op == "==" else there if op == "!=" else F.lit(False)
        if isinstance(a.type, T.NullType) or isinstance(b.type, T.NullType):
            return F.lit(False)
        if kind(a.type) != kind(b.type):
            return a.col.isNotNull() & b.col.isNotNull() if op == "!=" else F.lit(False)
        if isinstance(a.type, T.MapType):
            return F.lit(op == "!=")
        made = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
        return made[op](a.col, b.col)

    def condition(self, node: N.Node, cur: Val | None) -> Column:
        """A condition for a filter: null drops the record like false, so comparisons stay plain and reach the scan."""
        if isinstance(node, N.Binary) and node.op in ("and", "or"):
            a, b = self.condition(node.left, cur), self.condition(node.right, cur)
            return (a & b) if node.op == "and" else (a | b)
        if isinstance(node, N.Binary) and node.op in _COMPARISONS:
            return self._compare(node, cur)
        return self.truth(node, cur)

    def _arithmetic(self, op: str, a: Val, b: Val) -> Val:
        if is_number(a.type) and is_number(b.type):
            whole = is_whole(a.type) and is_whole(b.type)
            x, y = (v.col.cast("bigint" if whole else "double") for v in (a, b))
            if op in "+-*":
                t = T.LongType() if whole else T.DoubleType()
                return Val({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y), t)
            if op == "/":
                return Val(F.try_divide(x.cast("double"), y.cast("double")), T.DoubleType())
            return Val(F.when(y != 0, x - y * F.floor(x / y)).cast("bigint" if whole else "double"), T.LongType() if whole else T.DoubleType())
        if op != "+":
            return _null()
        if is_string(a.type) and is_string(b.type):
            return Val(F.concat(a.col, b.col), T.StringType())
        if is_array(a.type) and is_array(b.type):
            return self.typed(F.concat, a, b)
        if isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType):
            fields = {f.name: (a, f) for f in a.type} | {f.name: (b, f) for f in b.type}
            return Val(F.struct(*(v.col.getField(n).alias(n) for n, (v, _) in fields.items())), T.StructType([T.StructField(n, f.dataType) for n, (_, f) in fields.items()]))
        return _null()

    def _object(self, node: N.Object, cur: Val | None) -> Val:
        if any(isinstance(k, N.Node) for k, _ in node.fields):
            parts = [(self.compile(k, cur) if isinstance(k, N.Node) else Val(F.lit(k), T.StringType()), self.compile(v, cur)) for k, v in node.fields]
            first = parts[0][1]
            values = [self._alike(v, first)[0] for _, v in parts]
            return Val(F.map_from_arrays(F.array(*(k.col.cast("string") for k, _ in parts)), F.array(*(v.col for v in values))), T.MapType(T.StringType(), values[0].type))
        values = {k: self.compile(v, cur) for k, v in node.fields}
        return Val(F.struct(*(v.col.alias(k) for k, v in values.items())), T.StructType([T.StructField(k, v.type) for k, v in values.items()]))

    def _array(self, node: N.Array, cur: Val | None) -> Val:
        """All values of every item; items without a value are left out."""
        parts: list[Val] = []
        for item in node.items:
            many = self.many(item, cur)
            if many is not None:
                parts.append(many)
            else:
                v = self.compile(item, cur)
                parts.append(Val(F.filter(F.array(v.col), lambda x: x.isNotNull()), T.ArrayType(v.type)))
        if not parts:
            return Val(F.array().cast("array<string>"), T.ArrayType(T.StringType()))
        if len(parts) == 1:
            return parts[0]
        return self.typed(lambda *c: F.concat(*(F.coalesce(x, F.slice(x, 1, 0)) for x in c)), *parts)

    def many(self, node: N.Node, cur: Val | None) -> Val | None:
        """A node with many values as an array, or None if it has at most one."""
        if isinstance(node, N.Iterate):
            base = self.many(node.base, cur) or self.compile(node.base, cur)
            return base if is_array(base.type) else _null()
        if isinstance(node, N.Pipe):
            left = self.many(node.left, cur)
            return None if left is None else self.mapped(left, node.right)
        return None

    def mapped(self, base: Val, body: N.Node) -> Val:
        """body of every element, without those that give nothing."""
        if not is_array(base.type):
            return _null()
        out = self.typed(lambda c: F.transform(c, lambda x: self.compile(body, Val(x, base.type.elementType)).col), base)
        return Val(F.filter(out.col, lambda x: x.isNotNull()), out.type)

    def _call(self, node: N.Call, cur: Val | None) -> Val:
        name, args = node.name, node.args
        if name in GENERATORS and not args:
            return self.typed(lambda: GENERATORS[name]())
        if name == "select":
            own = self._identity(N.Identity(), cur)
            return Val(F.when(self.truth(args[0], cur), own.col), own.type)
        value = self.compile(args[0], cur) if name == "negate_of" else self._identity(N.Identity(), cur)
        if name == "not":
            return Val(~(F.coalesce(value.col, F.lit(False)) if is_bool(value.type) else value.col.isNotNull()), T.BooleanType())
        if name in FUNCTIONS and (not args or name == "negate_of"):
            if isinstance(value.type, T.NullType):
                value = Val(value.col.cast("string"), T.StringType()) if name in ("type", "isnull", "bool", "empty") else value
                if name == "type":
                    return Val(F.lit("null"), T.StringType())
            return self.typed(lambda c: FUNCTIONS[name](c, value.type), value)
        if name in STRINGS:
            return self.typed(lambda c: STRINGS[name](c, value.type, args[0].value), value)
        if name == "map" and len(args) == 1:
            return self.mapped(value, args[0])
        if name == "del" and len(args) == 1:
            return self.delete(value, args[0])
        if name in ("sort_by", "unique_by", "min_by", "max_by", "group_by"):
            return self.by(name, value, args[0])
        raise ExpressionError(f"unknown function {name!r}")

    def delete(self, value: Val, target: N.Node) -> Val:
        """The value without a field or array element; a missing one changes nothing."""
        path = N.path_of(target)
        if path and isinstance(value.type, T.StructType):
            return self.typed(lambda c: c.dropFields(".".join(map(quoted, path))) if self._there(value.type, path) else c, value)
        if isinstance(target, N.Index):
            at, base = target.at, N.path_of(target.base)
            cut = lambda a: F.filter(a, lambda _, i: i != (F.lit(at) if at >= 0 else F.size(a) + at))
            if isinstance(target.base, N.Identity) and is_array(value.type):
                return Val(cut(value.col), value.type)
            if base and isinstance(value.type, T.StructType) and self._there(value.type, base):
                return self.typed(lambda c: c.withField(".".join(map(quoted, base)), cut(c[base[0]] if len(base) == 1 else c.getField(base[0]).getField(base[1]))), value)
        return value

    def _there(self, t: T.DataType, path: tuple[str, ...]) -> bool:
        for name in path:
            if not isinstance(t, T.StructType) or name not in t.names:
                return False
            t = t[name].dataType
        return True

    def by(self, name: str, base: Val, key: N.Node) -> Val:
        """The by-functions on an array value; ties keep input order."""
        if not is_array(base.type):
            return _null()
        key_of = lambda x: self.compile(key, Val(x, base.type.elementType)).col
        keyed = self.typed(lambda c: F.transform(c, lambda x, i: F.struct(key_of(x).isNull().alias("m"), key_of(x).alias("k"), i.alias("i"), x.alias("v"))), base)
        ordered = F.sort_array(F.transform(keyed.col, lambda e: F.struct(e["m"], e["k"], e["i"])))
        pick = lambda e: F.get(base.col, e["i"])
        found = F.filter(ordered, lambda e: ~e["m"])
        if name == "sort_by":
            return Val(F.transform(ordered, pick), base.type)
        if name == "unique_by":
            first = F.filter(keyed.col, lambda e: ~e["m"] & (F.size(F.filter(keyed.col, lambda o: (o["k"] == e["k"]) & (o["i"] < e["i"]))) == 0))
            return Val(F.transform(first, lambda e: e["v"]), base.type)
        if name == "group_by":
            keys = F.array_distinct(F.transform(found, lambda e: e["k"]))
            return Val(F.transform(keys, lambda k: F.transform(F.filter(found, lambda e: e["k"] == k), pick)), T.ArrayType(base.type))
        if name == "min_by":
            return Val(pick(F.try_element_at(found, F.lit(1))), base.type.elementType)
        best = F.array_max(F.transform(found, lambda e: F.struct(e["k"], (-e["i"]).alias("o"), e["i"])))
        return Val(F.get(base.col, best["i"]), base.type.elementType)


def _stage(df: DataFrame, node: N.Node, scalar: bool) -> tuple[DataFrame, bool]:
    """One stage of a pipe over a stream; scalar: the records are single values in the column value."""
    c = Compiler(df)
    cur = Val(F.col("value"), df.schema["value"].dataType) if scalar else None
    if isinstance(node, N.Identity):
        return df, scalar
    if isinstance(node, N.Call) and node.name == "select":
        return df.where(c.condition(node.args[0], cur)), scalar
    if isinstance(node, N.Call) and node.name == "del" and not scalar and (path := N.path_of(node.args[0])) and len(path) == 1:
        return df.drop(*[x for x in df.columns if x == path[0]]), False
    if isinstance(node, N.Iterate):
        base = c.compile(node.base, cur)
        if not is_array(base.type):
            return df.where("false").select(F.lit(None).alias("value")), True
        return _spread(df.select(F.explode(base.col).alias("value")), base.type.elementType)
    many = c.many(node, cur)
    if many is not None:
        return _spread(df.select(F.explode(many.col).alias("value")), many.type.elementType)
    if isinstance(node, N.Object) and not any(isinstance(k, N.Node) for k, _ in node.fields):
        values = {k: c.compile(v, cur) for k, v in node.fields}
        return df.select(*(v.col.alias(k) for k, v in values.items())), False
    v = c.compile(node, cur)
    return _spread(df.select(v.col.alias("value")).where("value is not null"), v.type)


def _spread(df: DataFrame, t: T.DataType) -> tuple[DataFrame, bool]:
    return (df.select("value.*"), False) if isinstance(t, T.StructType) else (df, True)


def apply(df: DataFrame, expression: str | N.Node) -> DataFrame:
    """The stream that an expression makes of df's records.

    select() becomes a filter, an object a projection, .[] an explode; single
    values are in a column ``value``.  Filters and columns stay plain expressions
    that the scan can take over.
    """
    scalar = df.columns == ["value"]
    for node in N.stages(parse(expression) if isinstance(expression, str) else expression):
        df, scalar = _stage(df, node, scalar)
    return df
