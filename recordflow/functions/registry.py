"""Functions by name.

A nullary function takes (column, type) and gives a Column, or None where that
type has no value (the row is dropped at top level).  Everything stays in
built-in expressions, and no function raises on bad data: ``try_`` forms are used
where the session's ANSI mode would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[Column, T.DataType], "Column | None"]

#: Alphabets of the id functions.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
URL_SAFE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
BASE32_HEX = "0123456789abcdefghijklmnopqrstuv"
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\r"


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_whole(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_string(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_bool(t: T.DataType) -> bool:
    return isinstance(t, T.BooleanType)


def is_array(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def is_object(t: T.DataType) -> bool:
    return isinstance(t, T.StructType | T.MapType)


def kind(t: T.DataType) -> str:
    """The language's name of a type."""
    for name, test in (("boolean", is_bool), ("number", is_number), ("array", is_array), ("object", is_object), ("null", lambda x: isinstance(x, T.NullType))):
        if test(t):
            return name
    return "string"


def number(f: Callable[[Column], Column]) -> Builder:
    return lambda c, t: f(c) if is_number(t) else None


def string(f: Callable[[Column], Column]) -> Builder:
    return lambda c, t: f(c) if is_string(t) else None


def array(f: Callable[[Column], Column]) -> Builder:
    return lambda c, t: f(c) if is_array(t) else None


def plain_double(c: Column) -> Column:
    """A double as text, whole ones without the fraction."""
    text = c.cast("string")
    return F.when(F.isnan(c), F.lit("null")).when((F.abs(c) < 1e15) & (c == F.floor(c)), F.floor(c).cast("bigint").cast("string")).otherwise(text)


def _tostring(c: Column, t: T.DataType) -> Column | None:
    if is_array(t) or is_object(t):
        return None
    return plain_double(c.cast("double")) if isinstance(t, T.DoubleType | T.FloatType) else c.cast("string")


def _tonumber(c: Column, t: T.DataType) -> Column | None:
    """A double, as a column has one type: whole text is exact up to 2^53.  No blanks are trimmed."""
    if is_number(t):
        return c
    if not is_string(t):
        return None
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))


def _length(c: Column, t: T.DataType) -> Column | None:
    if is_string(t):
        return F.octet_length(c).cast("bigint")
    if is_array(t) or isinstance(t, T.MapType):
        return F.size(c).cast("bigint")
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.lit(len(t)).cast("bigint"))
    return None


def _keys(c: Column, t: T.DataType) -> Column | None:
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.array(*(F.lit(n) for n in t.names)))
    return F.map_keys(c) if isinstance(t, T.MapType) else None


def _values(c: Column, t: T.DataType) -> Column | None:
    if isinstance(t, T.MapType):
        return F.map_values(c)
    if not isinstance(t, T.StructType):
        return None
    kinds = {f.dataType for f in t}
    if len(kinds) == 1:
        return F.array(*(c[n] for n in t.names))
    text = lambda v: F.regexp_extract(F.to_json(F.array(v)), r"^\[(?s:(.*))\]$", 1)  # noqa: E731  values of several types: each as JSON text
    return F.array(*(text(c[n]) for n in t.names))


def _to_entries(c: Column, t: T.DataType) -> Column | None:
    if isinstance(t, T.MapType):
        return F.map_entries(c)
    if not isinstance(t, T.StructType):
        return None
    kinds = {f.dataType for f in t}
    return F.array(*(F.struct(F.lit(n).alias("key"), (c[n] if len(kinds) == 1 else c[n].cast("string")).alias("value")) for n in t.names))


def _from_entries(c: Column, t: T.DataType) -> Column | None:
    """Keys key, k or name; values value or v; the last of equal keys wins."""
    if not (is_array(t) and isinstance(t.elementType, T.StructType)):
        return None
    names = t.elementType.names
    k = next((n for n in ("key", "k", "name") if n in names), None)
    v = next((n for n in ("value", "v") if n in names), None)
    if k is None or v is None:
        return None
    last = F.aggregate(c, F.create_map().cast(T.MapType(T.StringType(), t.elementType[v].dataType)), lambda m, e: F.when(e[k].isNull() | e[v].isNull(), m).otherwise(F.map_concat(F.map_filter(m, lambda x, _: x != e[k]), F.create_map(e[k].cast("string"), e[v]))))
    return last


def _int(c: Column, t: T.DataType) -> Column | None:
    if is_whole(t) or is_bool(t):
        return c.cast("bigint")
    if is_number(t):
        return c.try_cast("bigint")
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint")) if is_string(t) else F.lit(None).cast("bigint")


def _float(c: Column, t: T.DataType) -> Column | None:
    if is_bool(t):
        return c.cast("int").cast("double")
    return c.try_cast("double") if is_number(t) or is_string(t) else F.lit(None).cast("double")


def _bool(c: Column, t: T.DataType) -> Column:
    test = c if is_bool(t) else c != 0 if is_number(t) else c != "" if is_string(t) else F.size(c) > 0 if is_array(t) or isinstance(t, T.MapType) else F.lit(len(t) > 0) if isinstance(t, T.StructType) else F.lit(False)
    return F.coalesce(test, F.lit(False))


def _add(c: Column, t: T.DataType) -> Column | None:
    if not is_array(t):
        return None
    e = t.elementType
    if is_number(e):
        zero = F.lit(0).cast("bigint" if is_whole(e) else "double")
        total = F.aggregate(c, zero, lambda a, x: F.when(x.isNull(), a).otherwise(F.try_add(a, x.cast("bigint" if is_whole(e) else "double"))))
        return F.when(F.size(c) > 0, total)
    if is_string(e):
        return F.when(F.size(c) > 0, F.array_join(c, ""))
    return F.flatten(F.filter(c, lambda x: x.isNotNull())) if is_array(e) else None


def _sort(c: Column, t: T.DataType) -> Column | None:
    return F.sort_array(c) if is_array(t) and not isinstance(t.elementType, T.MapType) else None


def _round(f: Callable[[Column], Column]) -> Builder:
    return lambda c, t: (c if is_whole(t) else f(c).try_cast("bigint")) if is_number(t) else None


def _step(by: int) -> Builder:
    """One more or less; null beyond the column's whole numbers."""
    return number(lambda c: F.try_add(c, F.lit(by)))


def _sign(f: Callable[[Column], Column]) -> Builder:
    """abs and negate; null for the least whole number, whose opposite the column's type lacks."""
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
    return lambda c, t: (F.when(c != F.lit(-(1 << (bits[type(t)] - 1))), f(c)) if type(t) in bits else f(c)) if is_number(t) else None


def _domain(f: Callable[[Column], Column], test: Callable[[Column], Column]) -> Builder:
    return number(lambda c: F.when(test(c), f(c.cast("double"))))


def _pieces(c: Column) -> Column:
    return F.filter(F.split(c, "[ _-]+", -1), lambda w: w != "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def _capital(c: Column) -> Column:
    return F.concat(ascii_upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def _snake(c: Column, mark: str = "_") -> Column:
    broken = F.regexp_replace(c, "([a-z])([A-Z])", f"$1{mark}$2")
    return F.regexp_replace(ascii_lower(F.regexp_replace(broken, "[ _-]", mark)), f"^{mark}+", "")


def _camel(c: Column) -> Column:
    """Separators go, the letter after one is upper-case, all others lower-case."""
    parts = F.split(ascii_lower(c), "[ _-]", -1)
    return F.array_join(F.transform(parts, lambda w, i: F.when(i == 0, w).otherwise(_capital(w))), "")


def _title(c: Column) -> Column:
    """Words start after blank, tab, newline, - and _."""
    return F.array_join(F.transform(F.regexp_extract_all(ascii_lower(c), F.lit(r"([^ \t\n_-]*[ \t\n_-]|[^ \t\n_-]+$)"), F.lit(1)), _capital), "")


def _trim(side: str) -> Callable[[Column], Column]:
    pattern = {"both": r"^[ \t\n\r]+|[ \t\n\r]+$", "left": r"^[ \t\n\r]+", "right": r"[ \t\n\r]+$"}[side]
    return lambda c: F.regexp_replace(c, pattern, "")


def _empty(c: Column, t: T.DataType) -> Column:
    if is_string(t):
        return F.coalesce(c == "", F.lit(False))
    if is_array(t) or isinstance(t, T.MapType):
        return F.coalesce(F.size(c) == 0, F.lit(False))
    return F.lit(False)


def seconds_of(c: Column, t: T.DataType) -> Column | None:
    """Epoch seconds of a whole number or ISO text; bad text gives null."""
    if is_whole(t):
        return c.cast("bigint")
    if not is_string(t):
        return None
    text = F.regexp_replace(F.substring(c, 1, 19), "T", " ")
    return F.unix_timestamp(F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))))


def _delta(c: Column, t: T.DataType) -> Column | None:
    s = seconds_of(c, t)
    return None if s is None else F.unix_timestamp() - s


def ago_text(seconds: Column) -> Column:
    """The two largest units of a span of seconds, as words; months have 30 and years 365 days."""
    size = F.abs(seconds)
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
    two = lambda a, x, b, y: F.concat(part(a, x), F.when(b > 0, F.concat(F.lit(", "), part(b, y))).otherwise(""))
    whole = lambda unit: F.floor(size / unit)
    days = whole(86400)
    words = (
        F.when(size < 60, part(size, "second"))
        .when(size < 3600, part(whole(60), "minute"))
        .when(size < 86400, two(whole(3600), "hour", F.floor(size % 3600 / 60), "minute"))
        .when(days < 30, two(days, "day", F.floor(size % 86400 / 3600), "hour"))
        .when(F.floor(days / 30) < 12, two(F.floor(days / 30), "month", days % 30, "day"))
        .otherwise(two(F.floor(days / 365), "year", F.floor(days % 365 / 30), "month"))
    )
    return F.concat(words, F.when(seconds < 0, " from now").otherwise(" ago"))


def _ago(c: Column, t: T.DataType) -> Column | None:
    d = _delta(c, t)
    return None if d is None else ago_text(d)


def _xid_time(c: Column) -> Column:
    """The upper 32 of 96 bits of 20 base-32 digits: the first 7 digits hold 31 of them (the first has one bit), the 8th the rest."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.call_function("instr", F.lit(BASE32_HEX), F.substr(c, i, F.lit(1))) - 1)
    value = F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a * 32 + d)
    return F.when(c.rlike("^[0-9a-v]{20}$"), F.floor(value / 16).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


FUNCTIONS: dict[str, Builder] = {
    "tonumber": _tonumber,
    "tostring": _tostring,
    "type": lambda c, t: F.when(c.isNull(), "null").otherwise(F.lit(kind(t))),
    "length": _length,
    "keys": _keys,
    "values": _values,
    **{f"is{n}": (lambda c, t, n=n: c.isNotNull() & F.lit(kind(t) == n)) for n in ("number", "string", "boolean", "array", "object")},
    "isnull": lambda c, t: c.isNull(),
    "to_entries": _to_entries,
    "from_entries": _from_entries,
    "int": _int,
    "float": _float,
    "bool": _bool,
    "first": array(lambda c: F.try_element_at(c, F.lit(1))),
    "last": array(lambda c: F.try_element_at(c, F.lit(-1))),
    "reverse": lambda c, t: F.reverse(c) if is_array(t) or is_string(t) else None,
    "sort": _sort,
    "unique": lambda c, t: _sort(F.array_distinct(c), t) if is_array(t) else None,
    "flatten": lambda c, t: (F.flatten(c) if is_array(t.elementType) else c) if is_array(t) else None,
    "add": _add,
    "min": array(F.array_min),
    "max": array(F.array_max),
    "floor": _round(F.floor),
    "ceil": _round(F.ceil),
    "round": _round(lambda c: F.round(c)),
    "abs": _sign(F.abs),
    "fabs": _sign(F.abs),
    "exp": number(F.exp),
    "ln": _domain(F.ln, lambda c: c > 0),
    "log10": _domain(F.log10, lambda c: c > 0),
    "log2": _domain(F.log2, lambda c: c > 0),
    "sqrt": _domain(F.sqrt, lambda c: c >= 0),
    "sin": number(F.sin),
    "cos": number(F.cos),
    "tan": number(F.tan),
    "asin": _domain(F.asin, lambda c: c.between(-1, 1)),
    "acos": _domain(F.acos, lambda c: c.between(-1, 1)),
    "atan": number(F.atan),
    "incr": _step(1),
    "decr": _step(-1),
    "negate": _sign(lambda c: -c),
    "toggle": lambda c, t: ~c if is_bool(t) else None,
    "not": lambda c, t: ~_bool_truth(c, t),
    "ascii_downcase": string(ascii_lower),
    "ascii_upcase": string(ascii_upper),
    "trim": string(_trim("both")),
    "ltrim": string(_trim("left")),
    "rtrim": string(_trim("right")),
    "capitalize": string(_capital),
    "titlecase": string(_title),
    "snakecase": string(_snake),
    "kebabcase": string(lambda c: _snake(c, "-")),
    "screamcase": string(lambda c: ascii_upper(_snake(c))),
    "camelcase": string(_camel),
    "pascalcase": string(lambda c: _capital(_camel(c))),
    "slugify": string(lambda c: F.regexp_replace(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")),
    "words": string(lambda c: F.filter(F.split(c, r"[ \t\n\r]+", -1), lambda w: w != "")),
    "lines": string(lambda c: F.transform(F.split(c, "\n", -1), lambda w: F.regexp_replace(w, "\r$", ""))),
    "chars": string(lambda c: F.filter(F.split(c, "", -1), lambda w: w != "")),
    "empty": _empty,
    "delta": _delta,
    "ago": _ago,
    "xid_time": string(_xid_time),
}


def _bool_truth(c: Column, t: T.DataType) -> Column:
    """Null and false are false; everything else is true."""
    return F.coalesce(c, F.lit(False)) if is_bool(t) else c.isNotNull()


def _locate_pattern(p: str) -> Callable[[Column], Column]:
    """test(): ^ and $ anchor, all else is literal."""
    start, end = p.startswith("^"), p.endswith("$") and len(p) > 1
    body = p[start : len(p) - end]
    if start and end:
        return lambda c: c == body
    return (lambda c: c.startswith(body)) if start else (lambda c: c.endswith(body)) if end else (lambda c: c.contains(body))


def _has(c: Column, t: T.DataType, key: object) -> Column:
    if isinstance(t, T.StructType):
        return F.lit(key in t.names)
    if isinstance(t, T.MapType):
        return F.coalesce(F.map_contains_key(c, F.lit(key)), F.lit(False))
    if is_array(t) and str(key).isdigit():
        return F.coalesce(F.size(c) > int(key), F.lit(False))
    return F.lit(False)


#: Functions of a string literal: (column, type, literal).
STRINGS: dict[str, Callable] = {
    "split": lambda c, t, s: F.split(c, "\\Q" + s + "\\E", -1) if is_string(t) else None,
    "join": lambda c, t, s: F.array_join(c, s) if is_array(t) and is_string(t.elementType) else F.lit("") if is_array(t) else None,
    "startswith": lambda c, t, s: c.startswith(s) if is_string(t) else None,
    "endswith": lambda c, t, s: c.endswith(s) if is_string(t) else None,
    "contains": lambda c, t, s: c.contains(s) if is_string(t) else None,
    "ltrimstr": lambda c, t, s: F.when(c.startswith(s), F.substr(c, F.lit(len(s) + 1))).otherwise(c) if is_string(t) else None,
    "rtrimstr": lambda c, t, s: F.when(c.endswith(s), F.substring(c, F.lit(1), F.char_length(c) - len(s))).otherwise(c) if is_string(t) else None,
    "has": _has,
    "test": lambda c, t, s: _locate_pattern(s)(c) if is_string(t) else None,
}


def _drawn(alphabet: str, n: int) -> Callable[[], Column]:
    return lambda: F.concat(*(F.substr(F.lit(alphabet), (F.floor(F.rand() * len(alphabet)) + 1).cast("int"), F.lit(1)) for _ in range(n)))


def _base(value: Column, alphabet: str, digits: int) -> Column:
    """A whole number in the digits of an alphabet whose size is a power of two."""
    bits = len(alphabet).bit_length() - 1
    return F.concat(*(F.substr(F.lit(alphabet), (F.shiftright(value, bits * k).bitwiseAND(F.lit(len(alphabet) - 1)) + 1).cast("int"), F.lit(1)) for k in range(digits - 1, -1, -1)))


def _millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def _random_hex(n: int) -> Column:
    return _drawn("0123456789abcdef", n)()


def _uuid7() -> Column:
    time = F.lpad(F.lower(F.hex(_millis())), 12, "0")
    return F.concat(F.substring(time, 1, 8), F.lit("-"), F.substring(time, 9, 4), F.lit("-7"), _random_hex(3), F.lit("-"), _drawn("89ab", 1)(), _random_hex(3), F.lit("-"), _random_hex(12))


def _xid() -> Column:
    """20 digits of 96 bits: seconds in the upper 32, the rest random; the first digit holds one bit."""
    head = F.unix_timestamp() * 16 + F.floor(F.rand() * 16).cast("bigint")
    return F.concat(_base(head, BASE32_HEX, 8), _drawn(BASE32_HEX, 12)())


def _clock(pattern: str) -> Callable[[], Column]:
    return lambda: F.date_format(F.current_timestamp(), pattern)


#: Functions that ignore their input.  The clock is one for the whole query.
GENERATORS: dict[str, Callable[[], Column]] = {
    "now": _clock("yyyy-MM-dd'T'HH:mm:ss'Z'"),
    "today": _clock("yyyy-MM-dd"),
    "time": _clock("HH:mm:ss"),
    "weekday": _clock("EEEE"),
    "epoch": lambda: F.unix_timestamp(),
    "epoch_ms": _millis,
    "year": lambda: F.year(F.current_timestamp()),
    "month": lambda: F.month(F.current_timestamp()),
    "day": lambda: F.dayofmonth(F.current_timestamp()),
    "hour": lambda: F.hour(F.current_timestamp()),
    "minute": lambda: F.minute(F.current_timestamp()),
    "second": lambda: F.second(F.current_timestamp()),
    "week": lambda: F.weekofyear(F.current_timestamp()),
    "weekday_num": lambda: F.dayofweek(F.current_timestamp()) - 1,
    "uuid": lambda: F.expr("uuid()"),
    "shortid": _drawn(BASE62, 8),
    "sid": _drawn(BASE62, 6),
    "nanoid": _drawn(URL_SAFE, 21),
    "ulid": lambda: F.concat(_base(_millis(), CROCKFORD, 10), _drawn(CROCKFORD, 16)()),
    "uuid7": _uuid7,
    "xid": _xid,
    "random": lambda: F.rand(),
    "seq": lambda: F.monotonically_increasing_id() + 1,
}
