"""Expressions over a whole stream, as relational plans.

A slurped stream is an array whose elements are rows.  Every stage of the expression
rewrites one description of such arrays (Rel): which columns name an element at
each level of nesting and in what order, and which columns tell one array from another
(ctx), as the arrays of a group_by are many.  So a sort is a change of that description,
a slice of it a top-k, group_by a further level, map() a step into a level and back, and
[] a mark that the level's elements are the results.  Only what must be one value
becomes an aggregate by ctx; the stream is never gathered into one array, and an array that the
result itself holds is gathered for its own group only.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import ExpressionError, parse
from ..expr import tree as N
from ..functions.registry import is_array, is_number, is_string, is_whole
from .compiler import Compiler, Val, quoted

#: Columns beside the records' own begin with this.
_HIDDEN = "__slurp_"
_numbers = itertools.count()


def _name() -> str:
    return f"{_HIDDEN}{next(_numbers)}"


@dataclass(frozen=True)
class By:
    """A column that orders elements; values that are missing come last, or first when reversed."""

    name: str
    down: bool = False
    missing_first: bool = False

    def column(self) -> Column:
        c = F.col(self.name)
        if self.down:
            return c.desc_nulls_first() if self.missing_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.missing_first else c.asc_nulls_last()

    def reversed(self) -> By:
        return By(self.name, not self.down, not self.missing_first)


def _call(node: N.Node, *names: str) -> bool:
    return isinstance(node, N.Call) and node.name in names


def _joined(parts: list[N.Node]) -> N.Node:
    out = parts[0]
    for p in parts[1:]:
        out = N.Pipe(out, p)
    return out


def _bare(node: N.Node) -> bool:
    """Whether a path begins at the array itself."""
    return isinstance(node.base, N.Identity)


@dataclass(frozen=True)
class Rel:
    """Arrays (levels), or single values (none), one for each value of ctx.

    scalar: an element is the column value, else the record of all columns that are
    not hidden.  keys: expressions whose value over an element of this array is a column of ctx.
    on: where arrays are many, elements that were dropped stay as rows on which this is false, so an
    array that lost all is still there.  stream: the first level's elements are results of their own.
    """

    df: DataFrame
    scalar: bool
    ctx: tuple[str, ...] = ()
    levels: tuple[tuple[By, ...], ...] = ((),)
    keys: dict[N.Node, str] = field(default_factory=dict)
    on: str | None = None
    stream: bool = False
    known: bool = True  # the order of the last level is known
    sorts: int = 0  # 1: the result is to be in the first level's order; 2: df is

    def shown(self) -> DataFrame:
        return self.df.select(*(quoted(c) for c in self.df.columns if not c.startswith(_HIDDEN)))

    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(_HIDDEN)]

    def compiler(self) -> tuple[Compiler, Val | None]:
        df = self.shown()
        return Compiler(df), Val(F.col("value"), df.schema["value"].dataType) if self.scalar else None

    def value(self) -> Val:
        c, cur = self.compiler()
        return cur or c.root()

    def compile(self, node: N.Node) -> Val:
        c, cur = self.compiler()
        return c.compile(node, cur)

    def live(self, column: Column) -> Column:
        return column if self.on is None else F.when(F.col(self.on), column)

    def ordered(self) -> Rel:
        """With a known order: where none is, rows have that in which they are read."""
        if self.known or len(self.levels) != 1:
            return self
        return replace(self, df=self.df.withColumn(n := _name(), F.monotonically_increasing_id()), levels=((*self.levels[0], By(n)),), known=True)

    def with_column(self, name: str, column: Column) -> Rel:
        return replace(self, df=self.df.withColumn(name, column))

    def kept(self, condition: Column) -> Rel:
        """Elements that meet a condition."""
        if not self.ctx:
            return replace(self, df=self.df.where(condition))
        condition = F.coalesce(condition, F.lit(False))
        on = _name()
        return replace(self.with_column(on, condition if self.on is None else F.col(self.on) & condition), on=on)


# elements


def _shaped(r: Rel, v: Val) -> Rel:
    """r with v as its elements' value; elements without one go."""
    if isinstance(v.type, T.StructType):
        whole = _name()
        out = replace(r, df=r.df.withColumn(whole, v.col), scalar=False).kept(F.col(whole).isNotNull())
        names = [f.name for f in v.type]
        return replace(out, df=out.df.select(*(F.col(whole).getField(n).alias(n) for n in names), *(h for h in out.hidden() if h != whole)))
    out = replace(r, df=r.df.select(v.col.alias("value"), *r.hidden()), scalar=True)
    return out.kept(F.col("value").isNotNull())


def _element(r: Rel, node: N.Node) -> Rel:
    """One stage on each element (r has no levels); a stage with many values adds a level that is a stream."""
    c, cur = r.compiler()
    if isinstance(node, N.Identity):
        return r
    if _call(node, "select"):
        return r.kept(c.condition(node.args[0], cur))
    many = c.many(node, cur)
    if many is not None:
        if not is_array(many.type):
            return _shaped(r.kept(F.lit(False)), Val(F.lit(None).cast("string"), T.StringType()))
        at = _name()
        hidden = r.hidden()
        spread = (F.posexplode_outer if r.ctx else F.posexplode)(many.col).alias(at, "value")
        return _shaped(replace(r, df=r.df.select(*hidden, spread), scalar=True, levels=((By(at),),), stream=True), Val(F.col("value"), many.type.elementType))
    if isinstance(node, N.Object) and not any(isinstance(k, N.Node) for k, _ in node.fields):
        values = {k: c.compile(v, cur) for k, v in node.fields}
        return replace(r, df=r.df.select(*(v.col.alias(k) for k, v in values.items()), *r.hidden()), scalar=False)
    return _shaped(r, c.compile(node, cur))


def _each(r: Rel, body: list[N.Node]) -> Rel:
    """body on every element of the first level; what streams inside an element joins the level."""
    outer, inner = r.levels[0], r.levels[1:]
    own = replace(r, levels=inner, stream=False, ctx=r.ctx + tuple(b.name for b in outer) if inner else r.ctx)
    out = _stages(own, body)
    levels = (outer + out.levels[0], *out.levels[1:]) if out.stream else (outer, *out.levels)
    return replace(out, ctx=r.ctx, levels=levels, keys=r.keys if inner else {}, stream=r.stream, known=out.known if inner else r.known, sorts=out.sorts if out.stream else r.sorts)


# arrays


def _one(r: Rel, aggregates: dict[str, Column]) -> Rel:
    """One row of aggregates for each array."""
    grouped = r.df.groupBy(*r.ctx) if r.ctx else r.df
    return replace(r, df=grouped.agg(*(c.alias(k) for k, c in aggregates.items())), levels=(), on=None, scalar=list(aggregates) == ["value"], stream=False, known=True, sorts=0)


def _slice(r: Rel, start: int, end: int | None) -> Rel:
    """Elements from start to before end, in order."""
    if len(r.levels) > 1:
        return _groups_between(r, start, end)
    if start < 0:
        if end is not None:
            raise ExpressionError("a slice that begins at a negative place must go to the end")
        return _reverse(_slice(_reverse(r), 0, -start))
    if end is not None and end < 0:
        if start:
            raise ExpressionError("a slice that ends at a negative place must begin at 0")
        return _reverse(_slice(_reverse(r), -end, None))
    r = r.ordered()
    order = [b.column() for b in r.levels[0]]
    if not r.ctx:
        df = r.df.orderBy(*order)
        df = df.offset(start) if start else df
        return replace(r, df=df if end is None else df.limit(max(0, end - start)), sorts=2)
    n, first = _name(), [F.col(r.on).desc()] if r.on else []
    numbered = r.with_column(n, F.row_number().over(Window.partitionBy(*r.ctx).orderBy(*first, *order)))
    if end is not None:  # the first row stays as the array's own
        numbered = replace(numbered, df=numbered.df.where(F.col(n) <= max(1, end)))
    if start == 0 and end is not None and end > 0:
        return numbered
    return numbered.kept(F.col(n) > start if end is None else (F.col(n) > start) & (F.col(n) <= end))


def _groups_between(r: Rel, start: int, end: int | None) -> Rel:
    if r.ctx or start < 0 or end is not None and end < 0:
        raise ExpressionError("a slice of groups inside groups is not supported")
    outer = r.levels[0]
    heads = r.df.select(*(b.name for b in outer)).distinct().orderBy(*(b.column() for b in outer))
    heads = heads.offset(start) if start else heads
    heads = heads if end is None else heads.limit(max(0, end - start))
    return replace(r, df=r.df.join(heads, [b.name for b in outer], "left_semi").select(*r.df.columns))


def _reverse(r: Rel) -> Rel:
    r = r.ordered()
    return replace(r, levels=(tuple(b.reversed() for b in r.levels[0]), *r.levels[1:]), sorts=1)


def _at(r: Rel, place: int) -> Rel:
    """The element at a place, as a value; arrays that have none there have no row."""
    if place < 0:
        return _at(_reverse(r), -place - 1)
    if not r.ctx or len(r.levels) > 1:
        out = _slice(r, place, place + 1)
    else:
        r, n = r.ordered(), _name()
        first = [F.col(r.on).desc()] if r.on else []
        rank = F.row_number().over(Window.partitionBy(*r.ctx).orderBy(*first, *(b.column() for b in r.levels[0])))
        rows = r.df.withColumn(n, rank).where(F.col(n) == place + 1)
        out = replace(r, df=(rows.where(r.on) if r.on else rows).drop(n), on=None)
    return replace(out, levels=r.levels[1:], known=True, stream=False, sorts=0)


def _sort(r: Rel, key: N.Node | None) -> Rel:
    if len(r.levels) > 1:
        return _sort_groups(r, key)
    k = _name()
    own = r.value() if key is None else r.compile(key)
    return replace(r.with_column(k, own.col), levels=((By(k), *r.levels[0]),), sorts=1)


def _sort_groups(r: Rel, key: N.Node | None) -> Rel:
    """Groups in the order of a value of each: its aggregate, joined by the group's own columns."""
    if key is None:
        raise ExpressionError("arrays of arrays have no order; sort them by something")
    outer = r.levels[0]
    names = r.ctx + tuple(b.name for b in outer)
    found = _single(_stages(replace(r, levels=r.levels[1:], ctx=names), N.stages(key)))
    k = _name()
    ranks = found.df.select(*names, found.value().col.alias(k))
    a, b = r.df.alias("a"), ranks.alias("b")
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
    return replace(r, df=a.join(b, same, "left").select("a.*", f"b.{k}"), levels=((By(k), *outer), *r.levels[1:]), sorts=1)


def _group(r: Rel, key: N.Node) -> Rel:
    """A level above: elements with one value of key; those without one go."""
    k, v = _name(), r.compile(key)
    out = r.with_column(k, r.live(v.col)).kept(F.col(k).isNotNull())
    return replace(out, levels=((By(k),), r.levels[0]), keys={key: k}, sorts=0)


def _first_of_each(r: Rel, key: N.Node) -> Rel:
    """The first element of every value of key: a least-by aggregate, so no value's rows meet in one task."""
    r = _group(r.ordered(), key)
    inner, names = r.levels[1], r.ctx + (r.levels[0][0].name,)
    rest = [c for c in r.df.columns if c not in names]
    if any(b.down for b in inner) and not all(b.down for b in inner):
        raise ExpressionError("unique_by after sorts of both directions is not supported")
    pick = (F.max_by if inner[0].down else F.min_by)(F.struct(*(quoted(c) for c in rest)), F.struct(*(b.name for b in inner)))
    own = replace(r, df=(r.df if r.on is None else r.df.where(r.on)).groupBy(*names).agg(pick.alias("w")).select(*names, "w.*"), keys={})
    return replace(own, levels=(inner,))


def _unique(r: Rel) -> Rel:
    """Different values, sorted."""
    own, k = r.value(), _name()
    shown = [c for c in r.df.columns if not c.startswith(_HIDDEN)]
    kept = [*r.ctx, *([r.on] if r.on else [])]
    df = r.df.select(*(r.live(F.col(quoted(c))).alias(c) for c in shown), *kept).distinct().withColumn(k, own.col)
    return replace(r, df=df, levels=((By(k),),), known=True, sorts=1, keys={})


def _flat(r: Rel) -> Rel:
    """Elements of elements."""
    if len(r.levels) > 1:
        return replace(r, levels=(r.levels[0] + r.levels[1], *r.levels[2:]))
    return _each(r, [N.Iterate(N.Identity())]) if is_array(r.value().type) else r


class _Aggregates:
    """Expressions over an array as aggregates of its rows; None where something else is needed."""

    def __init__(self, r: Rel):
        self.r = r

    def column(self, node: N.Node) -> Column | None:
        parts = N.stages(node)
        return self.single(node) if len(parts) == 1 else self.pipe(parts)

    def pipe(self, parts: list[N.Node]) -> Column | None:
        head, rest = parts[0], parts[1:]
        if _call(head, "first", "last") or isinstance(head, N.Index) and _bare(head) and head.at in (0, -1):
            return self.end(rest, _call(head, "last") or isinstance(head, N.Index) and head.at == -1)
        if _call(head, "group_by", "unique_by") and len(rest) == 1 and _call(rest[0], "length"):
            return F.count_distinct(self.r.live(self.r.compile(head.args[0]).col))
        if _call(head, "map"):
            body = head.args[0]
            while rest and _call(rest[0], "map"):
                body, rest = N.Pipe(body, rest[0].args[0]), rest[1:]
            plain = not any(isinstance(s, N.Iterate) for s in N.stages(body))
            return self.fold(self.r.compile(body), rest) if plain else None
        return None

    def end(self, rest: list[N.Node], last: bool) -> Column | None:
        body = _joined(rest) if rest else N.Identity()
        if body in self.r.keys:
            return F.col(self.r.keys[body])
        order = self.r.levels[0]
        if any(b.down for b in order) and not all(b.down for b in order) or not order or any(isinstance(s, N.Iterate) for s in rest):
            return None
        rank = F.struct(*(F.col(b.name) for b in order))
        rank = rank if self.r.on is None else F.when(F.col(self.r.on), rank)
        return (F.max_by if last != order[0].down else F.min_by)(self.r.compile(body).col, rank)

    def fold(self, v: Val, rest: list[N.Node]) -> Column | None:
        col = self.r.live(v.col)
        name = rest[0].name if rest and isinstance(rest[0], N.Call) and not rest[0].args else ""
        if name == "unique" and len(rest) == 2 and _call(rest[1], "length"):
            return F.count_distinct(col)
        if len(rest) != 1:
            return None
        if name == "add":
            if is_number(v.type):
                return F.sum(col.cast("bigint" if is_whole(v.type) else "double"))
            return None
        if is_array(v.type) or isinstance(v.type, T.StructType) and name != "length":
            return None
        table = {"min": F.min, "max": F.max, "length": F.count, "unique": lambda c: F.sort_array(F.collect_set(c)), "sort": lambda c: F.sort_array(F.collect_list(c))}
        if name in ("unique", "sort") and not self.r.ctx:
            return None
        return table[name](col) if name in table else None

    def single(self, node: N.Node) -> Column | None:
        r = self.r
        if _call(node, "length"):
            return F.count(F.lit(1)) if r.on is None else F.count_if(r.on)
        if isinstance(node, N.Literal):
            return F.lit(node.value)
        if _call(node, "add", "min", "max") and r.scalar:
            return self.fold(r.value(), [node])
        if _call(node, "first", "last") or isinstance(node, N.Index) and _bare(node) and node.at in (0, -1):
            return self.pipe([node, N.Identity()]) if r.scalar else None
        if isinstance(node, N.Binary) and node.op in "+-*/%":
            a, b = self.column(node.left), self.column(node.right)
            if a is None or b is None:
                return None
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[node.op](a, b) if node.op in "+-*" else F.try_divide(a, b) if node.op == "/" else F.when(b != 0, a - b * F.floor(a / b))
        if _call(node, "min_by", "max_by") and not r.levels[0]:
            return (F.min_by if node.name == "min_by" else F.max_by)(r.live(r.value().col), r.live(r.compile(node.args[0]).col))
        return None


def _extreme(r: Rel, key: N.Node, down: bool) -> Rel:
    """The element with the least or greatest key; the first of equal ones."""
    k, v = _name(), r.compile(key)
    r = r.with_column(k, v.col).kept(F.col(k).isNotNull())
    return _at(replace(r, levels=((By(k, down), *r.levels[0]),)), 0)


def _gathered(r: Rel) -> Rel:
    """The first level's elements as one array value for each ctx, in their order."""
    if len(r.levels) > 1:
        inner = _gathered(replace(r, levels=r.levels[1:], ctx=r.ctx + tuple(b.name for b in r.levels[0])))
        r = replace(inner, ctx=r.ctx, levels=r.levels[:1])
    order = r.levels[0]
    if any(b.down for b in order) and not all(b.down for b in order):
        raise ExpressionError("an array inside a result that is sorted in both directions is not supported")
    places = [c for i, b in enumerate(order) for c in (F.col(b.name).isNull().alias(f"m{i}"), F.col(b.name).alias(f"k{i}"))]
    packed = F.collect_list(r.live(F.struct(*places, r.value().col.alias("v"))))
    if order:
        packed = F.sort_array(packed, asc=not order[0].down)
    return _one(r, {"value": F.transform(packed, lambda e: e["v"])})


def _single(r: Rel) -> Rel:
    """r as one value for each ctx."""
    return _gathered(r) if r.levels else r


def _combined(r: Rel, fields: dict[str, N.Node]) -> Rel:
    """An object of values over one array: one pass of aggregates, and the fields that need plans of their own put beside it by ctx."""
    for r in (r, r.ordered()):  # the first or last element needs an order
        agg = _Aggregates(r)
        done = {k: agg.column(v) if len(r.levels) == 1 else None for k, v in fields.items()}
        if r.known or all(c is not None for c in done.values()):
            break
    plain = {k: c for k, c in done.items() if c is not None}
    if len(plain) == len(fields):
        return replace(_one(r, plain), scalar=False)
    parts = [_one(r, plain or {_name(): F.count(F.lit(1))}).df]
    for k, node in fields.items():
        if done[k] is None:
            own = _single(_stages(r, N.stages(node)))
            parts.append(own.df.select(*r.ctx, (own.live(own.value().col)).alias(k)))
    # a row of each part for each ctx, put together by an aggregate
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return replace(r, df=(out.groupBy(*r.ctx) if r.ctx else out).agg(*(F.first(quoted(k), ignorenulls=True).alias(k) for k in fields)), levels=(), on=None, scalar=False, stream=False, known=True, sorts=0)


def _computed(r: Rel, node: N.Node) -> Rel:
    """An operation on values of the array: each operand is a column, then it is one expression on a row."""
    operands: dict[str, N.Node] = {}

    def leaf(x: N.Node) -> N.Node:
        if isinstance(x, N.Literal):
            return x
        if isinstance(x, N.Binary):
            return N.Binary(x.op, leaf(x.left), leaf(x.right))
        if isinstance(x, N.Not):
            return N.Not(leaf(x.inner))
        if isinstance(x, N.If):
            return N.If(leaf(x.test), leaf(x.then), leaf(x.other))
        if isinstance(x, N.Array):
            return N.Array(tuple(map(leaf, x.items)))
        name = f"v{len(operands)}"
        operands[name] = x
        return N.Field(N.Identity(), name)

    shape = leaf(node)
    return _element(_combined(r, operands or {"v0": N.Call("length")}), shape)


def _selected(r: Rel, condition: N.Node) -> Rel:
    """Arrays of which a condition on the whole array is true."""
    ruled = _computed(r, condition)
    c, cur = ruled.compiler()
    names = r.ctx or (_name(),)
    met = ruled.df.where(c.truth(N.Identity(), cur)).select(*(F.lit(1).alias(n) if not r.ctx else F.col(n) for n in names))
    rows = r.df if r.ctx else r.df.withColumn(names[0], F.lit(1))
    a, b = rows.alias("a"), met.alias("b")
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
    return replace(r, df=a.join(b, same, "left_semi").select(*r.df.columns))


def _array(r: Rel, node: N.Node) -> Rel:
    """One stage on arrays."""
    flat = len(r.levels) == 1
    if isinstance(node, N.Identity):
        return r
    if isinstance(node, N.Iterate):
        out = r if _bare(node) else _stages(r, [node.base])
        return replace(out, stream=True) if out.levels else _element(out, N.Iterate(N.Identity()))
    if isinstance(node, N.Index | N.Slice) and not _bare(node):
        return _stages(_stages(r, [node.base]), [replace(node, base=N.Identity())])
    if isinstance(node, N.Index):
        return _at(r, node.at)
    if isinstance(node, N.Slice):
        return _slice(r, node.start or 0, node.end)
    if isinstance(node, N.Object) and all(isinstance(k, str) for k, _ in node.fields):
        return _combined(r, dict(node.fields))
    if isinstance(node, N.Array) and len(node.items) == 1:
        out = _stages(r, N.stages(node.items[0]))
        if out.stream or not out.levels and not isinstance(node.items[0], N.Literal):
            return replace(out, stream=False, levels=out.levels or ((),))
    if isinstance(node, N.Binary | N.Not | N.If | N.Array | N.Literal):
        return _computed(r, node)
    if not isinstance(node, N.Call):
        raise ExpressionError("a field of an array has no value")
    name, args = node.name, node.args
    if name == "map":
        return _each(r, N.stages(args[0]))
    if name == "select":
        return _selected(r, args[0])
    if name in ("first", "last") and not args:
        return _at(r, 0 if name == "first" else -1)
    if name == "reverse":
        return _reverse(r)
    if name in ("flatten",) or name == "add" and not (flat and (r.scalar and (is_number(r.value().type) or is_string(r.value().type)))):
        return _flat(r)
    if name in ("sort", "sort_by"):
        return _sort(r, args[0] if args else None)
    if name == "length" and not flat:
        return _one(r, {"value": F.count_distinct(F.struct(*(r.live(F.col(b.name)) for b in r.levels[0])) if len(r.levels[0]) > 1 else r.live(F.col(r.levels[0][0].name)))})
    if not flat:
        raise ExpressionError(f"{name} of an array of arrays is not supported")
    if name == "group_by":
        return _group(r, args[0])
    if name == "unique_by":
        return _first_of_each(r, args[0])
    if name in ("min_by", "max_by"):
        return _extreme(r, args[0], name == "max_by")
    if name == "unique":
        return _unique(r)
    found = _Aggregates(r).single(node)
    if found is not None:
        return _one(r, {"value": found})
    return _element(_gathered(r.ordered()), node)  # any other function of an array, on that of each ctx


def _stages(r: Rel, parts: list[N.Node]) -> Rel:
    for i, node in enumerate(parts):
        if isinstance(node, N.Pipe):
            return _stages(r, [*N.stages(node), *parts[i + 1 :]])
        if r.stream:
            return _each(r, parts[i:])
        if r.levels:
            rest = parts[i:]
            found = _Aggregates(r).pipe(rest) if len(r.levels) == 1 and len(rest) > 1 else None
            if found is not None:
                return _drop_missing(_one(r, {"value": found}))
        r = _array(r, node) if r.levels else _element(r, node)
    return r


def _drop_missing(r: Rel) -> Rel:
    return _shaped(r, Val(F.col("value"), r.df.schema["value"].dataType))


def slurp(df: DataFrame, expression: str, order: list[str] | None = None) -> DataFrame:
    """What an expression makes of the whole stream.

    order names columns that give the stream's order (ties of sorts, first, last, reverse,
    unique_by); without it, where an order matters, it is that in which partitions are read.
    A result that is an array comes as its elements, in order if it is sorted, reversed or
    sliced (groups come in any order); an array inside it is one value.
    Elements whose value is null or missing are left out.
    """
    start = Rel(df, df.columns == ["value"], known=bool(order))
    if order:
        named = [_name() for _ in order]
        start = replace(start, df=df.select("*", *(F.col(quoted(c)).alias(n) for c, n in zip(order, named, strict=True))), levels=(tuple(map(By, named)),))
    out = _stages(start, N.stages(parse(expression)))
    if len(out.levels) > 1:
        inner = _gathered(replace(out, levels=out.levels[1:], ctx=tuple(b.name for b in out.levels[0])))
        out = replace(inner, ctx=(), levels=out.levels[:1])
    if out.on:
        out = replace(out, df=out.df.where(out.on))
    rows = out.df.orderBy(*(b.column() for b in out.levels[0])) if out.levels and out.levels[0] and out.sorts == 1 else out.df
    return rows.select(*(quoted(c) for c in rows.columns if not c.startswith(_HIDDEN)))
