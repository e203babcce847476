"""Equi-joins of records, membership tests and containment joins.

The strategy of equi-joins is Catalyst's and adaptive execution's; nothing of a table's size is broadcast by hand.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import free_name
from .ranges import cuts, place, row_hash


def _family(t: T.DataType) -> str:
    return "number" if isinstance(t, T.NumericType) else "text" if isinstance(t, T.StringType) else t.typeName()


def _lacks(keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.col(f"`{k}`").isNull()
    return out


def _with_keys(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """df, with an error for a record that lacks a key."""
    return df.where(F.when(_lacks(keys), F.raise_error(F.lit(f"a record of the {side} side lacks {', '.join(keys)}")).cast("boolean")).otherwise(True))


def join(left: DataFrame, right: DataFrame, on: str | list[str] | None = None, left_key: str | list[str] | None = None, right_key: str | list[str] | None = None, how: str = "left", null_keys: bool = False, suffix: str | None = None, indicator: str | None = None, strict: bool = False, skipped: tuple[Observation, Observation] | None = None) -> DataFrame:
    """Left (default), inner, right, full, semi or anti join on keys of possibly different names.

    The right key columns are left out.  Where both sides have a column the right
    one wins, unless ``suffix`` keeps both.  Keys of different kinds (text and
    number) never match.  ``null_keys``: null matches null.  Records without a key
    find no partner: ``strict`` makes them an error when the job meets one, and
    ``skipped`` (an Observation for each side) has their number as ``missing_keys``
    when an action is done, with no pass of its own.
    """
    listed = lambda k: [k] if isinstance(k, str) else list(k or [])
    lk, rk = listed(left_key or on), listed(right_key or on)
    if not lk or len(lk) != len(rk):
        raise ValueError("give on, or as many left as right keys")
    if strict:
        left, right = _with_keys(left, lk, "left"), _with_keys(right, rk, "right")
    if skipped:
        left, right = (df.observe(o, F.count_if(_lacks(k)).alias("missing_keys"), F.count(F.lit(1)).alias("records")) for df, k, o in zip((left, right), (lk, rk), skipped, strict=True))
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    test: Column | None = None
    for a, b in zip(lk, rk, strict=True):
        x, y = F.col(f"l.`{a}`"), F.col(f"r.`{b}`")
        same = _family(left.schema[a].dataType) == _family(right.schema[b].dataType)
        own = (x.eqNullSafe(y) if null_keys else x == y) if same else F.lit(False)
        test = own if test is None else test & own
    if how in ("semi", "anti"):
        return l.join(r, test, f"left_{how}")
    here, there = free_name("_here", left.columns), free_name("_there", right.columns)
    if indicator:
        l, r = left.withColumn(here, F.lit(True)).alias("l"), right.withColumn(there, F.lit(True)).alias("r")  # noqa: E741
    joined = l.join(r, test, how)
    extra = [c for c in right.columns if c not in rk]
    outer = how in ("right", "full", "outer")
    out = []
    for c in left.columns:
        col = F.col(f"l.`{c}`")
        if outer and c in lk:
            col = F.coalesce(col, F.col(f"r.`{rk[lk.index(c)]}`"))
        if c not in extra or suffix is not None:
            out.append(col.alias(c))
        else:
            out.append(F.coalesce(F.col(f"r.`{c}`"), col).alias(c) if left.schema[c].dataType == right.schema[c].dataType else F.col(f"r.`{c}`").alias(c))
    out += [F.col(f"r.`{c}`").alias(c + suffix if suffix is not None and c in left.columns else c) for c in extra if suffix is not None or c not in left.columns]
    if indicator:
        out.append(F.when(F.col(f"r.{there}").isNull(), "left_only").when(F.col(f"l.{here}").isNull(), "right_only").otherwise("both").alias(indicator))
    return joined.select(*out)


def semi(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Records of left with a partner in right, once each."""
    return join(left, right, left_key=left_key, right_key=right_key, how="semi")


def anti(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Records of left without a partner in right."""
    return join(left, right, left_key=left_key, right_key=right_key, how="anti")


#: Rows of a range of an as-of join about, and ranges at most.
ASOF_ROWS, ASOF_RANGES = 50_000, 1024


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keys: list[tuple[str, str]] = (), direction: str = "backward", tolerance: str | float | None = None, how: str = "left", suffix: str = "_right") -> DataFrame:
    """Each row of left with the latest row of right that is not later (backward), or the earliest that is not earlier (forward).

    keys are pairs of columns that must be equal.  tolerance: the greatest distance of the two times, a
    number or an interval like "5 minutes".  Columns of right that left has get the suffix; inner leaves rows
    without a partner out.  A row without a key or time has none.  Of rows of right with equal key and time one is taken, by hash.

    Both sides are cut into common ranges of (key, time), so a key with most of the rows spreads over
    many tasks; a range begins with the last row of right before it, one row for each range.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    back = direction == "backward"
    taken = [c.lower() for c in left.columns]
    names = {c: c + suffix if c.lower() in taken else c for c in right.columns}
    lk, rk = [k for k, _ in keys], [k for _, k in keys]

    def side(df: DataFrame, own: list[str], time: str, right_side: bool) -> DataFrame:
        # in the order of time, or against it, a row of right comes before rows of left at the same time
        rank = F.lit(int(right_side != back))
        key = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(own)), F.lit(0).alias("none"))
        return df.select(key.alias("key"), F.col(f"`{time}`").alias("t"), rank.alias("side"), row_hash(df).alias("h"), F.struct("*").alias("r" if right_side else "l"))

    whole = lambda own, time: ~_lacks([*own, time])
    a, b = side(left.where(whole(lk, left_time)), lk, left_time, False), side(right.where(whole(rk, right_time)), rk, right_time, True)
    both = a.unionByName(b, allowMissingColumns=True)
    at = F.struct("key", "t", "side", "h")
    bounds = cuts(both.select(at.alias("k"), "h"), ASOF_RANGES, ASOF_ROWS)
    both = both.withColumn("range", place(at, bounds))
    order = [F.col(c) if back else F.col(c).desc() for c in ("t", "side", "h")]
    found = both.withColumn("m", F.last("r", ignorenulls=True).over(Window.partitionBy("range", "key").orderBy(*order)))
    found = found.where("l is not null")
    if bounds:
        ends = both.groupBy("range").agg((F.max_by if back else F.min_by)(F.when(F.col("r").isNotNull(), F.struct("key", "r")), F.when(F.col("r").isNotNull(), at)).alias("end"))  # a row for each range
        before = Window.orderBy(F.col("range") if back else F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(F.col("range").alias("to"), F.last("end", ignorenulls=True).over(before).alias("end"))
        found = found.join(F.broadcast(carried), F.col("range") == F.col("to"), "left").withColumn("m", F.coalesce("m", F.when(F.col("end.key") == F.col("key"), F.col("end.r"))))
    if tolerance is not None:
        far = F.expr(f"interval {tolerance}") if isinstance(tolerance, str) else F.lit(tolerance)
        other = F.col(f"m.`{right_time}`")
        near = other >= F.col("t") - far if back else other <= F.col("t") + far
        found = found.withColumn("m", F.when(near, F.col("m")))
    shown = [F.col(f"m.`{c}`").alias(n) for c, n in names.items()]
    if how == "inner":
        return found.where("m is not null").select("l.*", *shown)
    alone = left.where(_lacks([*lk, left_time])).select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in names.items()))
    return found.select("l.*", *shown).unionAll(alone)


#: Points of a cell of an interval join about, and cells at most.
CELL_ROWS, CELLS = 500, 4096


def _covers(a: Column, b: Column, leaves: int) -> Column:
    """Nodes of a binary tree over the cells that together cover cells a to b: two of each level at most."""
    none = F.array().cast("array<int>")

    def up(acc: Column, _: Column) -> Column:
        low, high = acc["low"], acc["high"]
        go = low < high
        one, two = go & (low % 2 == 1), go & (high % 2 == 1)
        nodes = F.concat(acc["nodes"], F.when(one, F.array(low)).otherwise(none), F.when(two, F.array(high - 1)).otherwise(none))
        return F.struct(F.shiftright(F.when(one, low + 1).otherwise(low), 1).alias("low"), F.shiftright(F.when(two, high - 1).otherwise(high), 1).alias("high"), nodes.alias("nodes"))

    begin = F.struct((a + leaves).cast("int").alias("low"), (b + leaves + 1).cast("int").alias("high"), none.alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(leaves.bit_length() - 1)), begin, up, lambda acc: acc["nodes"])


def range_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], value: str, start: str | None, end: str | None, ends: str = "both") -> DataFrame:
    """Rows of left and right with equal keys and left.value between right.start and right.end, those included.

    start or end None: unbounded on that side.  ends: "both", or which of them counts as inside ("start", "end", "neither").
    Quantiles of (keys, value) cut left into cells.  A row of it stands in one cell, and an interval in each cell from its
    beginning to its end.  All of these but the first and the last hold nothing but partners of it, so its copies are few beside
    its results.  Keys of different kinds have no common order; there cells are of the value alone, and a binary tree
    over them covers each interval with at most two nodes a level, and a value stands in one node of each level in use.
    Both sides are dealt by cell to as many tasks as the session shuffles to, as the work lies in the pairs and not in the rows
    read.  A null never matches.
    """
    taken = [*left.columns, *right.columns]
    node = free_name("_node", taken)
    way = free_name("_nodes", [*taken, node])
    a = left.where(~_lacks([value, *(x for x, _ in keys)]))
    b = right.where(~_lacks([c for c in (start, end, *(y for _, y in keys)) if c is not None]))
    if start is not None and end is not None:
        b = b.where(F.col(f"`{start}`") <= F.col(f"`{end}`"))
    kind = lambda df, c: df.schema[c].dataType
    alike = lambda x, y: x == y or isinstance(x, T.NumericType) and isinstance(y, T.NumericType)
    together = all(alike(kind(left, x), kind(right, y)) for x, y in keys)
    groups = [(x, y) for x, y in keys if together]
    common = lambda x, *others: functools.reduce(DataFrame.unionAll, (b.select(f"`{y}`") for y in others), a.select(f"`{x}`")).schema[0].dataType
    types = [*(common(x, y) for x, y in groups), common(value, *(c for c in (start, end) if c is not None))]

    def at(own: list[str], v: str | None, side: int = 0) -> Column:
        """The place of a value after those of smaller keys; without a value, before or after all of its keys."""
        shown = [F.col(f"`{c}`").cast(t).alias(f"k{i}") for i, (c, t) in enumerate(zip(own, types, strict=False))]
        return F.struct(*shown, F.lit(side).alias("side"), (F.lit(None) if v is None else F.col(f"`{v}`")).cast(types[-1]).alias("v"))

    ours, theirs = [x for x, _ in groups], [y for _, y in groups]
    bounds = cuts(a.select(at(ours, value).alias("k"), row_hash(a).alias("h")), CELLS, CELL_ROWS)
    first, last = (place(at(theirs, c, 0 if c is not None else side), bounds) for c, side in ((start, -1), (end, 1)))
    if together:
        a = a.withColumn(node, place(at(ours, value), bounds))
        b = b.withColumn(node, F.explode(F.sequence(first, last)))
    else:
        leaves = 1 << len(bounds).bit_length()
        b = b.withColumn(way, _covers(first, last, leaves)).withColumn(node, F.explode(way)).drop(way)
        top = leaves.bit_length() - 1
        used = [r[0] for r in b.select((top - F.floor(F.log2(F.col(node) + 0.5))).cast("int").alias("level")).distinct().collect()]  # a number for each level
        a = a.withColumn(node, (place(at(ours, value), bounds) + leaves).cast("int"))
        a = a.withColumn(way, F.array(*(F.shiftright(node, h) for h in sorted(used))) if used else F.array().cast("array<int>")).withColumn(node, F.explode(way)).drop(way)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (df.repartition(tasks, node, *(F.col(f"`{k[side]}`") for k in keys)) for side, df in enumerate((a, b)))
    l, r = (lambda c: F.col(f"l.`{c}`")), (lambda c: F.col(f"r.`{c}`"))  # noqa: E731, E741
    on = l(node) == r(node)
    for x, y in keys:
        on = on & (l(x) == r(y))
    if start is not None:
        on = on & (l(value) >= r(start) if ends in ("both", "start") else l(value) > r(start))
    if end is not None:
        on = on & (l(value) <= r(end) if ends in ("both", "end") else l(value) < r(end))
    # intervals pass by, and a task holds the points of one cell
    joined = b.alias("r").join(a.alias("l").hint("merge"), on)
    return joined.select(*(l(c) for c in left.columns), *(r(c) for c in right.columns))


def theta_join(left: DataFrame, right: DataFrame, value: str, op: str, bound: str, keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Rows of left and right with equal keys and left.value <, <=, > or >= right.bound, through the cells of range_join."""
    kinds = {"<": (None, bound, "start"), "<=": (None, bound, "both"), ">": (bound, None, "end"), ">=": (bound, None, "both")}
    if op not in kinds:
        raise ValueError("op is one of < <= > >=")
    start, end, ends = kinds[op]
    return range_join(left, right, list(keys), value, start, end, ends)


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Rows of left and right with equal keys whose intervals, ends included, have a common point.

    Either left begins inside right, or right begins inside left after its beginning; no pair does both.
    """
    whole = lambda df, span: df.where(F.col(f"`{span[0]}`") <= F.col(f"`{span[1]}`"))
    left, right = whole(left, left_span), whole(right, right_span)
    names = [f"c{i}" for i in range(len(left.columns) + len(right.columns))]
    one = range_join(left, right, list(keys), left_span[0], *right_span).toDF(*names)
    two = range_join(right, left, [(y, x) for x, y in keys], right_span[0], *left_span, ends="end")
    two = two.toDF(*names[len(left.columns) :], *names[: len(left.columns)]).select(*names)
    return one.unionAll(two).toDF(*left.columns, *right.columns)
