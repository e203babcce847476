"""Queries over the driver's tables, one for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import docstore, dynamic, tasks
from .functions.registry import ago_text
from .operators import analyze, anti, asof_join, edit, head, inspect_schema, join, merge, numbered, overlap_join, range_join, semi, tail, theta_join
from .plans import apply, slurp
from .profiles import run_sql
from .sources import load, with_lineage
from .streaming import tumbling_counts

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, f"{sf_dir}/{name}.parquet")


def _add(name: str, build: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame], sql: str | None) -> None:
    """Registers a query that gets (spark, table by name)."""
    _QUERIES[name] = lambda spark, sf_dir: build(spark, lambda t: _table(spark, sf_dir, t))
    if sql is not None:
        _SQL[name] = sql


def _expr(name: str, table: str, expression: str, sql: str, rename: str | None = None) -> None:
    """A query that is one expression over a table; its single value is named by rename."""

    def build(spark, t):
        out = apply(t(table), expression)
        return out.withColumnRenamed("value", rename) if rename else out

    _add(name, build, sql)


def _slurped(name: str, table: str, expression: str, sql: str, order: list[str] | None = None, rename: str | None = None) -> None:
    def build(spark, t):
        out = slurp(t(table), expression, order)
        return out.withColumnRenamed("value", rename) if rename else out

    _add(name, build, sql)




# projections, filters and control flow

_expr("identity", "nation", ".", "select * from nation")
_expr("field_project", "orders", "{key: .o_orderkey, price: .o_totalprice}", "select o_orderkey as key, o_totalprice as price from orders")
_expr("field_value", "region", ".r_name", "select r_name as name from region", "name")
_expr("select_gt", "orders", "select(.o_totalprice > 250000) | {o_orderkey, o_totalprice}", "select o_orderkey, o_totalprice from orders where o_totalprice > 250000")
_expr("select_eq", "orders", 'select(.o_orderstatus == "F") | {o_orderkey}', "select o_orderkey from orders where o_orderstatus = 'F'")
_expr("select_ne", "orders", 'select(.o_orderstatus != "F") | {o_orderkey}', "select o_orderkey from orders where o_orderstatus <> 'F'")
_expr("select_and_or", "orders", 'select(.o_orderstatus == "O" or .o_orderstatus == "P" and .o_totalprice < 50000) | {o_orderkey}', "select o_orderkey from orders where o_orderstatus = 'O' or o_orderstatus = 'P' and o_totalprice < 50000")
_expr("select_not", "orders", 'select(not (.o_orderstatus == "F")) | {o_orderkey}', "select o_orderkey from orders where not (o_orderstatus = 'F')")
_expr("select_missing", "orders", "select(not (.absent == 1)) | {o_orderkey}", "select o_orderkey from orders")
_expr("select_truthy", "customer", "select(.c_acctbal) | {c_custkey}", "select c_custkey from customer where c_acctbal is not null")
_expr("compare_columns", "lineitem", "select(.l_quantity * 1000 > .l_extendedprice) | {l_orderkey, l_quantity, l_extendedprice}", "select l_orderkey, l_quantity, l_extendedprice from lineitem where l_quantity * 1000 > l_extendedprice")
_expr("string_predicates", "part", 'select((.p_name | startswith("p")) or (.p_brand | endswith("3")) or (.p_type | contains("AN"))) | {p_partkey}', "select p_partkey from part where starts_with(p_name, 'p') or ends_with(p_brand, '3') or contains(p_type, 'AN')")
_expr("string_test", "part", 'select((.p_brand | test("^Brand")) and (.p_brand | test("2$"))) | {p_partkey}', "select p_partkey from part where starts_with(p_brand, 'Brand') and ends_with(p_brand, '2')")
_expr("alternative", "orders", '{o_orderkey, s: (.absent // .o_orderstatus // "-")}', "select o_orderkey, coalesce(o_orderstatus, '-') as s from orders")
_expr("conditional", "orders", '{o_orderkey, size: (if .o_totalprice > 300000 then "big" else (if .o_totalprice > 100000 then "mid" else "small" end) end)}', "select o_orderkey, case when o_totalprice > 300000 then 'big' when o_totalprice > 100000 then 'mid' else 'small' end as size from orders")
_expr("object_nested", "customer", "{k: .c_custkey, who: {name: .c_name, seg: .c_mktsegment}} | {k, seg: .who.seg}", "select c_custkey as k, c_mktsegment as seg from customer")
_expr("object_merge", "nation", "({a: .n_nationkey} + {a: .n_regionkey, b: .n_name})", "select n_regionkey as a, n_name as b from nation")
_expr("delete_field", "region", "del(.r_name)", "select r_regionkey from region")
_expr("arith_ops", "lineitem", "{l_orderkey, net: (.l_extendedprice * (1 - .l_discount)), q: (.l_quantity / 4), d: (.l_orderkey - .l_partkey - 2)}", "select l_orderkey, l_extendedprice * (1 - l_discount) as net, l_quantity / 4 as q, l_orderkey - l_partkey - 2 as d from lineitem")
_expr("arith_mod_floor", "orders", "{o_orderkey, a: (.o_orderkey % 7), b: ((3 - .o_orderkey) % 5)}", "select o_orderkey, cast(o_orderkey - 7 * floor(o_orderkey / 7) as bigint) as a, cast((3 - o_orderkey) - 5 * floor((3 - o_orderkey) / 5) as bigint) as b from orders")
_expr("divide_by_zero", "orders", "(.o_orderkey / (.o_orderkey - 5)) | {v: .}", "select o_orderkey / (o_orderkey - 5)::double as v from orders where o_orderkey <> 5")
_expr("string_concat", "nation", '{n: (.n_name + "-" + .n_name)}', "select n_name || '-' || n_name as n from nation")

# scalar functions

_expr("math_round", "customer", "{c_custkey, f: (.c_acctbal|floor), c: (.c_acctbal|ceil), r: (.c_acctbal|round), a: (.c_acctbal|abs), n: (.c_acctbal|negate), i: (.c_custkey|incr), d: (.c_custkey|decr)}", "select c_custkey, cast(floor(c_acctbal) as bigint) as f, cast(ceil(c_acctbal) as bigint) as c, cast(round(c_acctbal) as bigint) as r, abs(c_acctbal) as a, -c_acctbal as n, c_custkey + 1 as i, c_custkey - 1 as d from customer")
_add("math_logs", lambda s, t: apply(t("customer"), "{c_custkey, a: (.c_acctbal|ln), b: (.c_acctbal|log10), c: (.c_acctbal|log2), d: (.c_acctbal|sqrt), e: (.c_acctbal / 10000 | exp)}").select("c_custkey", *(F.round(c, 6).alias(c) for c in "abcde")), "select c_custkey, " + ", ".join(f"case when c_acctbal > 0 then round({f}(c_acctbal), 6) end as {c}" for c, f in (("a", "ln"), ("b", "log10"), ("c", "log2"))) + ", case when c_acctbal >= 0 then round(sqrt(c_acctbal), 6) end as d, round(exp(c_acctbal / 10000), 6) as e from customer")
_add("math_trig", lambda s, t: apply(t("lineitem"), "{l_orderkey, a: (.l_discount|sin), b: (.l_discount|cos), c: (.l_discount|tan), d: (.l_discount|asin), e: (.l_discount|acos), f: (.l_discount|atan), g: (.l_quantity|asin)}").select("l_orderkey", *(F.round(c, 6).alias(c) for c in "abcdefg")), "select l_orderkey, round(sin(l_discount), 6) as a, round(cos(l_discount), 6) as b, round(tan(l_discount), 6) as c, round(asin(l_discount), 6) as d, round(acos(l_discount), 6) as e, round(atan(l_discount), 6) as f, case when l_quantity <= 1 then round(asin(l_quantity), 6) end as g from lineitem")
_expr("coerce", "events", "{event_id, i: (.value|int), f: (.event_id|float), b: (.user_id|bool), s: (.event_id|tostring), t: (.event_id|tostring|tonumber|int)}", "select event_id, cast(trunc(value) as bigint) as i, cast(event_id as double) as f, user_id <> 0 as b, cast(event_id as varchar) as s, event_id as t from events")
_expr("types", "events", "{event_id, a: (.value|type), b: (.event_type|type), c: (.absent|type), d: (.value|isnumber), e: (.event_type|isstring), f: (.value|isnull), g: (.value|isboolean)}", "select event_id, 'number' as a, 'string' as b, 'null' as c, value is not null as d, event_type is not null as e, value is null as f, false as g from events")
_expr("string_case_ascii", "documents", "{doc_id, u: (.source|ascii_upcase), d: (.source|ascii_downcase), c: (.source|capitalize)}", "select doc_id, upper(source) as u, lower(source) as d, upper(source[1]) || source[2:] as c from documents")
_expr("string_case_snake", "part", "{p_partkey, a: (.p_type|snakecase), b: (.p_type|kebabcase), c: (.p_type|screamcase)}", "select p_partkey, lower(regexp_replace(regexp_replace(p_type, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[ _-]', '_', 'g')) as a, lower(regexp_replace(regexp_replace(p_type, '([a-z])([A-Z])', '\\1-\\2', 'g'), '[ _-]', '-', 'g')) as b, upper(regexp_replace(regexp_replace(p_type, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[ _-]', '_', 'g')) as c from part")
_CAMEL = "array_to_string(list_transform(string_split_regex(lower(p_type), '[ _-]'), lambda w, i: case when i = 1 then w else upper(w[1]) || w[2:] end), '')"
_expr("string_case_camel", "part", "{p_partkey, a: (.p_type|camelcase), b: (.p_type|pascalcase)}", f"select p_partkey, a, upper(a[1]) || a[2:] as b from (select p_partkey, {_CAMEL} as a from part)")
_expr("titlecase", "part", "{p_partkey, a: (.p_type|titlecase)}", "select p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as a from part")
_expr("slugify", "part", "{p_partkey, s: (.p_name|slugify)}", "select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as s from part")
_expr("trims", "part", '{p_partkey, a: ("  " + .p_name + " " | trim), b: (" " + .p_name | ltrim), c: (.p_name + "  " | rtrim), d: (.p_name | ltrimstr("p")), e: (.p_brand | rtrimstr("1"))}', "select p_partkey, p_name as a, p_name as b, p_name as c, case when starts_with(p_name, 'p') then p_name[2:] else p_name end as d, case when ends_with(p_brand, '1') then p_brand[:-2] else p_brand end as e from part")
_expr("words", "documents", "{doc_id, n: (.text|words|length)}", "select doc_id, cast(len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) as bigint) as n from documents")
_expr("lines", "documents", "{doc_id, n: (.text|lines|length)}", "select doc_id, cast(len(string_split(text, chr(10))) as bigint) as n from documents")
_expr("byte_length", "documents", "{doc_id, n: (.text|length), e: (.text|empty)}", "select doc_id, cast(strlen(text) as bigint) as n, text = '' as e from documents")
_expr("split_join", "part", '{p_partkey, s: (.p_type | split(" ") | join("+")), n: (.p_type | split(" ") | length)}', "select p_partkey, replace(p_type, ' ', '+') as s, cast(len(string_split(p_type, ' ')) as bigint) as n from part")
_expr("iso_format", "events", "{event_id, t: .ts}", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as t from events")
_expr("date_parts", "region", '{r_regionkey, d: ((today | split("-") | join("") | tonumber) == (year * 10000 + month * 100 + day)), t: ((time | split(":") | join("") | tonumber) == (hour * 10000 + minute * 100 + second)), e: ((epoch_ms / 1000 | floor) == epoch), w: ((week >= 1) and (week <= 53)), n: (weekday_num >= 0 and weekday_num <= 6), name: ((weekday | length) >= 6)}', "select r_regionkey, true as d, true as t, true as e, true as w, true as n, true as name from region")
_add("delta_between", lambda s, t: apply(t("events"), "{event_id, a: (.ts|delta), b: (.event_id|delta)}").select("event_id", (F.col("b") - F.col("a") + F.col("event_id")).alias("epoch")), "select event_id, cast(floor(epoch(ts)) as bigint) as epoch from events")
_expr("ids_generated", "region", "{r_regionkey, a: (uuid|length), b: (shortid|length), c: (sid|length), d: (nanoid|length), e: (ulid|length), f: (uuid7|length), g: (xid|length)}", "select r_regionkey, 36::bigint as a, 8::bigint as b, 6::bigint as c, 21::bigint as d, 26::bigint as e, 36::bigint as f, 20::bigint as g from region")
_expr("clock_generated", "region", "{r_regionkey, a: (now|length), b: (today|length), c: (time|length), ok: ((now|delta) < 100)}", "select r_regionkey, 20::bigint as a, 10::bigint as b, 8::bigint as c, true as ok from region")
_UNIT = lambda n, unit: f"concat({n}, ' {unit}', case when {n} = 1 then '' else 's' end)"
_UNITS = lambda a, x, b, y: f"concat({_UNIT(a, x)}, case when {b} > 0 then concat(', ', {_UNIT(b, y)}) else '' end)"
_add("ago_words", lambda s, t: t("orders").select("o_orderkey", ago_text((F.col("o_orderkey") - 50) * 9770).alias("w")), f"select o_orderkey, concat(case when s < 60 then {_UNIT('s', 'second')} when s < 3600 then {_UNIT('s // 60', 'minute')} when s < 86400 then {_UNITS('s // 3600', 'hour', 's % 3600 // 60', 'minute')} when d < 30 then {_UNITS('d', 'day', 's % 86400 // 3600', 'hour')} when d // 30 < 12 then {_UNITS('d // 30', 'month', 'd % 30', 'day')} else {_UNITS('d // 365', 'year', 'd % 365 // 30', 'month')} end, case when o_orderkey < 50 then ' from now' else ' ago' end) as w from (select o_orderkey, abs((o_orderkey - 50) * 9770) as s, abs((o_orderkey - 50) * 9770) // 86400 as d from orders)")

# arrays and dynamic values

_expr("array_index", "embeddings", "{vec_id, a: .embedding[0], b: .embedding[-1], c: .embedding[100000]}", "select vec_id, embedding[1] as a, embedding[-1] as b, embedding[100001] as c from embeddings")
_expr("array_slice", "embeddings", "{vec_id, a: .embedding[1:3], b: (.embedding[-2:] | length), c: (.embedding[5:2] | length)}", "select vec_id, embedding[2:3] as a, cast(len(embedding[-2:]) as bigint) as b, 0::bigint as c from embeddings")
_add("array_map_add", lambda s, t: apply(t("embeddings"), "{vec_id, s: (.embedding | map(. * 2) | add), n: (.embedding|length), f: (.embedding|first), l: (.embedding|last)}").withColumn("s", F.round("s", 4)), "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * 2)), 4) as s, cast(len(embedding) as bigint) as n, embedding[1] as f, embedding[-1] as l from embeddings")
_expr("array_min_max", "embeddings", "{vec_id, lo: (.embedding|min), hi: (.embedding|max)}", "select vec_id, list_min(embedding) as lo, list_max(embedding) as hi from embeddings")
_expr("array_sort_unique", "embeddings", "{vec_id, s: (.embedding | sort), u: (.embedding + .embedding | unique | length), r: (.embedding | reverse)}", "select vec_id, list_sort(embedding) as s, cast(len(list_distinct(embedding)) as bigint) as u, list_reverse(embedding) as r from embeddings")
_expr("array_filter", "embeddings", "{vec_id, n: (.embedding | map(select(. > 0)) | length)}", "select vec_id, cast(len(list_filter(embedding, lambda x: x > 0)) as bigint) as n from embeddings")
_expr("array_by", "embeddings", "{vec_id, a: (.embedding | max_by(.)), b: (.embedding | min_by(.)), c: (.embedding | sort_by(.) | first)}", "select vec_id, list_max(embedding) as a, list_min(embedding) as b, list_min(embedding) as c from embeddings")
_expr("iterate_explode", "embeddings", ".embedding[] | {x: .}", "select unnest(embedding) as x from embeddings")
_expr("entries_roundtrip", "nation", "{k: .n_nationkey, o: ({name: .n_name, twice: (.n_name + .n_name)} | to_entries | from_entries | to_entries | length), ks: ({b: 1, a: 2} | keys)}", "select n_nationkey as k, 2::bigint as o, ['b', 'a'] as ks from nation")
_expr("has_key", "nation", '{k: .n_nationkey, a: ({x: 1} | has("x")), b: ({x: 1} | has("y"))}', "select n_nationkey as k, true as a, false as b from nation")
_add("json_field", lambda s, t: dynamic.dynamic(t("events"), "props").select("event_id", dynamic.get("$.k", "bigint").alias("k")), "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
_add("json_type", lambda s, t: dynamic.dynamic(t("events"), "props").select("event_id", dynamic.type_of("$.k").alias("a"), dynamic.type_of("$.none").alias("b"), dynamic.type_of().alias("c")), "select event_id, 'number' as a, cast(null as varchar) as b, 'object' as c from events")
_add("json_keys", lambda s, t: t("events").select("event_id", dynamic.keys("props").alias("k")), "select event_id, json_keys(props) as k from events")

# aggregation over the whole stream and in groups

_slurped("group_count_sum", "orders", "group_by(.o_orderpriority) | map({p: .[0] | .o_orderpriority, n: length, s: (map(.o_totalprice) | add)}) | .[] | {p, n, s: (.s * 100 | round)}", "select o_orderpriority as p, count(*) as n, cast(round(sum(o_totalprice) * 100) as bigint) as s from orders group by 1")
_slurped("group_average", "lineitem", "group_by(.l_returnflag) | map({f: .[0] | .l_returnflag, a: ((map(.l_quantity) | add) / length), lo: (map(.l_quantity) | min), hi: (map(.l_quantity) | max)}) | .[] | {f, a: (.a * 10000 | round), lo, hi}", "select l_returnflag as f, cast(round(avg(l_quantity) * 10000) as bigint) as a, min(l_quantity) as lo, max(l_quantity) as hi from lineitem group by 1")
_slurped("group_collect", "nation", "group_by(.n_regionkey) | map({r: .[0] | .n_regionkey, names: (map(.n_name) | sort)}) | .[]", "select n_regionkey as r, list_sort(list(n_name)) as names from nation group by 1")
_slurped("group_unique", "customer", "group_by(.c_nationkey) | map({k: .[0] | .c_nationkey, segs: (map(.c_mktsegment) | unique)}) | .[]", "select c_nationkey as k, list_sort(list_distinct(list(c_mktsegment))) as segs from customer group by 1")
_slurped("global_agg", "orders", "{n: length, top: (map(.o_totalprice) | max), low: (map(.o_totalprice) | min), who: (group_by(.o_custkey) | length)}", "select count(*) as n, max(o_totalprice) as top, min(o_totalprice) as low, count(distinct o_custkey) as who from orders")
_slurped("count_distinct", "orders", "group_by(.o_custkey) | length", "select count(distinct o_custkey) as n from orders", rename="n")
_slurped("slurp_length", "lineitem", "length", "select count(*) as n from lineitem", rename="n")
_slurped("slurp_add", "lineitem", "map(.l_linenumber) | add", "select cast(sum(l_linenumber) as bigint) as n from lineitem", rename="n")
_slurped("slurp_map", "orders", "map(select(.o_totalprice > 400000)) | .[] | {o_orderkey}", "select o_orderkey from orders where o_totalprice > 400000")
_slurped("unique_by_first", "events", "unique_by(.user_id) | .[] | {user_id, event_id}", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k = 1", ["ts", "event_id"])
_slurped("min_by_row", "events", "min_by(.value) | {event_id, value}", "select event_id, value from events order by value, ts, event_id limit 1", ["ts", "event_id"])
_slurped("max_by_row", "events", "max_by(.value) | {event_id, value}", "select event_id, value from events order by value desc, ts, event_id limit 1", ["ts", "event_id"])
_slurped("slurp_last", "events", "last | {event_id, user_id}", "select event_id, user_id from events order by ts desc, event_id desc limit 1", ["ts", "event_id"])
_slurped("slurp_reverse_slice", "events", "reverse | .[5:25] | .[] | {event_id}", "select event_id from events order by ts desc, event_id desc limit 20 offset 5", ["ts", "event_id"])
_slurped("slurp_tail_slice", "orders", ".[-12:] | map(.o_orderkey)", "select o_orderkey as k from orders order by o_orderkey desc limit 12", ["o_orderkey"], rename="k")
_slurped("slurp_sort_slice", "orders", "map(.o_totalprice) | sort | .[0:15]", "select o_totalprice as p from orders order by o_totalprice limit 15", rename="p")
_slurped("slurp_unique_length", "lineitem", "map(.l_suppkey) | unique | length", "select count(distinct l_suppkey) as n from lineitem", rename="n")
_slurped("slurp_unique", "customer", "map(.c_mktsegment) | unique", "select distinct c_mktsegment as s from customer", rename="s")
_slurped("slurp_collect_length", "lineitem", "[.[] | select(.l_quantity > 25) | .l_orderkey] | length", "select count(*) as n from lineitem where l_quantity > 25", rename="n")
_slurped("slurp_mean", "lineitem", "(map(.l_linenumber) | add) / length | . * 1000 | round", "select cast(round(sum(l_linenumber) / count(*) * 1000) as bigint) as m from lineitem", rename="m")
_slurped("slurp_object_of_slices", "orders", "{n: length, top: (sort_by(.o_totalprice) | reverse | .[0:3] | map(.o_orderkey)), first: (first | .o_orderkey), dear: (map(select(.o_totalprice > 300000)) | length)}", "select (select count(*) from orders) as n, (select list(o_orderkey order by o_totalprice desc, o_orderkey desc) from (select * from orders order by o_totalprice desc, o_orderkey desc limit 3)) as top, (select min(o_orderkey) from orders) as first, (select count(*) from orders where o_totalprice > 300000) as dear", ["o_orderkey"])
_slurped("group_top_k", "orders", "group_by(.o_custkey) | map(sort_by(.o_totalprice) | reverse | .[0:3]) | flatten | .[] | {o_custkey, o_orderkey}", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) as k from orders) where k <= 3", ["o_orderkey"])
_slurped("group_first_row", "events", "group_by(.user_id) | map(sort_by(.value) | .[0]) | .[] | {user_id, event_id}", "select user_id, event_id from (select *, row_number() over (partition by user_id order by value, ts, event_id) as k from events) where k = 1", ["ts", "event_id"])
_slurped("group_second_row", "events", "group_by(.user_id) | map(.[1]) | .[] | {user_id, event_id}", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k = 2", ["ts", "event_id"])
_slurped("group_last_value", "events", "group_by(.user_id) | map({u: .[0] | .user_id, kind: last | .event_type}) | .[]", "select user_id as u, last(event_type order by ts, event_id) as kind from events group by user_id", ["ts", "event_id"])
_slurped("group_having", "orders", "group_by(.o_custkey) | map(select(length > 12)) | map({c: .[0] | .o_custkey, n: length}) | .[]", "select o_custkey as c, count(*) as n from orders group by o_custkey having count(*) > 12")
_slurped("group_filtered_counts", "events", "group_by(.user_id) | map({u: .[0] | .user_id, errors: (map(select(.event_type == \"error\")) | length)}) | .[]", "select user_id as u, count(*) filter (event_type = 'error') as errors from events group by user_id")
_slurped("group_by_size", "orders", "group_by(.o_custkey) | sort_by(length) | reverse | .[0:2] | map({c: .[0] | .o_custkey, n: length}) | .[]", "select o_custkey as c, count(*) as n from orders group by o_custkey order by n desc, c desc limit 2", ["o_orderkey"])
_slurped("group_nested", "events", "group_by(.event_type) | map(group_by(.user_id) | map({t: .[0] | .event_type, u: .[0] | .user_id, n: length})) | flatten | .[]", "select event_type as t, user_id as u, count(*) as n from events group by 1, 2", ["event_id"])
_slurped("group_lists", "nation", "group_by(.n_regionkey) | map(map(.n_nationkey))", "select list(n_nationkey order by n_name) as k from nation group by n_regionkey", ["n_name"], rename="k")
_slurped("sort_head", "orders", "sort_by(.o_orderdate) | .[0:25] | .[] | {o_orderkey}", "select o_orderkey from orders order by o_orderdate, o_orderkey limit 25", ["o_orderkey"])
_slurped("top_k", "orders", "sort_by(.o_totalprice) | reverse | .[0:10] | .[] | {o_orderkey, o_totalprice}", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey desc limit 10", ["o_orderkey"])
_add("head_n", lambda s, t: head(t("orders"), 7, ["o_orderkey"]).select("o_orderkey"), "select o_orderkey from orders order by o_orderkey limit 7")
_add("tail_n", lambda s, t: tail(t("events"), 12, ["ts", "event_id"]).select("event_id"), "select event_id from events order by ts desc, event_id desc limit 12")
_add("topk_terms", lambda s, t: head(apply(slurp(apply(t("documents"), ".text | ascii_downcase | words | .[] | {w: .}"), "group_by(.w) | map({w: .[0] | .w, n: length}) | .[]"), "{k: (0 - .n), w, n}"), 20, ["k", "w"]).select("w", "n"), "select w, count(*) as n from (select unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\r]+'), lambda x: x <> '')) as w from documents) group by w order by n desc, w limit 20")
_add("seq_numbers", lambda s, t: numbered(t("orders"), ["o_totalprice", "o_orderkey"], "k").select("o_orderkey", "k"), "select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as k from orders")

# joins, unions, profiles, edits


def _slim(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


_add("join_left", lambda s, t: join(_slim(t("customer"), "c_custkey", "c_name"), t("orders").where("o_totalprice > 450000").select("o_custkey", "o_orderkey"), left_key="c_custkey", right_key="o_custkey"), "select c_custkey, c_name, o_orderkey from customer left join (select * from orders where o_totalprice > 450000) on c_custkey = o_custkey")
_add("join_inner", lambda s, t: join(_slim(t("lineitem"), "l_partkey", "l_quantity", "l_extendedprice"), _slim(t("part"), "p_partkey", "p_brand"), left_key="l_partkey", right_key="p_partkey", how="inner"), "select l_partkey, l_quantity, l_extendedprice, p_brand from lineitem join part on l_partkey = p_partkey")
_add("join_same_name", lambda s, t: join(_slim(t("documents"), "doc_id", "lang"), t("labels"), on="doc_id"), "select doc_id, lang, quality, toxic from documents left join labels using (doc_id)")
_add("join_right_wins", lambda s, t: join(t("documents").select("doc_id", "lang"), t("labels").select("doc_id", F.col("quality").cast("string").alias("lang")), on="doc_id"), "select d.doc_id, coalesce(cast(quality as varchar), lang) as lang from documents d left join labels l on d.doc_id = l.doc_id")
_add("join_null_safe", lambda s, t: join(t("nation").select(F.nullif("n_regionkey", F.lit(1)).alias("k"), "n_name"), t("region").select(F.nullif("r_regionkey", F.lit(1)).alias("k"), "r_name"), on="k", how="inner", null_keys=True), "select nullif(n_regionkey, 1) as k, n_name, r_name from nation join region on nullif(n_regionkey, 1) is not distinct from nullif(r_regionkey, 1)")
_add("join_kinds_differ", lambda s, t: join(t("nation").select("n_nationkey"), t("region").select(F.col("r_regionkey").cast("string").alias("k"), "r_name"), left_key="n_nationkey", right_key="k"), "select n_nationkey, cast(null as varchar) as r_name from nation")
_add("join_composite", lambda s, t: join(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")), on=["l_orderkey", "l_linenumber"], how="inner"), "select a.l_orderkey, a.l_linenumber, l_partkey, l_quantity, n from lineitem a join (select l_orderkey, l_linenumber, count(*) as n from lineitem group by all) b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber")
_add("join_full_indicator", lambda s, t: join(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), on="c_custkey", how="full", indicator="side"), "select coalesce(c.c_custkey, o_custkey) as c_custkey, o_orderkey, case when o_orderkey is null then 'left_only' when c.c_custkey is null then 'right_only' else 'both' end as side from customer c full join orders on c.c_custkey = o_custkey")
_add("join_right_wins_all", lambda s, t: join(t("nation"), t("nation").select("n_nationkey", F.upper("n_name").alias("n_name")), on="n_nationkey"), "select n_nationkey, upper(n_name) as n_name, n_regionkey from nation")
_add("semi_join", lambda s, t: semi(t("customer"), t("orders").where("o_totalprice > 300000"), "c_custkey", "o_custkey").select("c_custkey"), "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
_add("anti_join", lambda s, t: anti(t("customer"), t("orders").where("o_totalprice > 300000"), "c_custkey", "o_custkey").select("c_custkey"), "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
_KIND = lambda t, kind: t("events").where(f"event_type = '{kind}'")
_ASOF = "select a.event_id, b.event_id as other, b.value as other_value from (select * from events where event_type = 'click') a asof {how} join (select * from events where event_type = 'error') b on a.user_id = b.user_id and a.ts {op} b.ts"


def _asof(t, **options) -> DataFrame:
    """Clicks with the error next to them of the same user."""
    return asof_join(_KIND(t, "click"), _KIND(t, "error"), "ts", "ts", [("user_id", "user_id")], **options).select("event_id", F.col("event_id_right").alias("other"), F.col("value_right").alias("other_value"))


_add("asof_backward", lambda s, t: _asof(t), _ASOF.format(how="left", op=">="))
_add("asof_forward", lambda s, t: _asof(t, direction="forward"), _ASOF.format(how="left", op="<="))
_add("asof_inner", lambda s, t: _asof(t, how="inner"), _ASOF.format(how="", op=">="))
_add("asof_tolerance", lambda s, t: _asof(t, tolerance="2 hours"), "select event_id, case when near then other end as other, case when near then other_value end as other_value from (select a.event_id, b.event_id as other, b.value as other_value, b.ts >= a.ts - interval 2 hours as near from (select * from events where event_type = 'click') a asof left join (select * from events where event_type = 'error') b on a.user_id = b.user_id and a.ts >= b.ts)")
_add("asof_one_key", lambda s, t: asof_join(t("events").where("event_type = 'view'"), _KIND(t, "error"), "ts", "ts").select("event_id", F.col("event_id_right").alias("other")), "select a.event_id, b.event_id as other from (select * from events where event_type = 'view') a asof left join (select * from events where event_type = 'error') b on a.ts >= b.ts")
_add("asof_number", lambda s, t: asof_join(t("orders"), t("customer"), "o_totalprice", "c_acctbal", tolerance=5000.0).select("o_orderkey", "c_acctbal"), "select o_orderkey, case when c_acctbal >= o_totalprice - 5000 then c_acctbal end as c_acctbal from orders asof left join customer on o_totalprice >= c_acctbal")
_add("interval_join_long", lambda s, t: range_join(t("orders").select("o_orderkey", "o_totalprice"), t("part").select("p_partkey", (F.col("p_retailprice") * 200).alias("lo"), (F.col("p_retailprice") * 200 + F.col("p_size") * F.col("p_size") / 20).alias("hi")), [], "o_totalprice", "lo", "hi").select("o_orderkey", "p_partkey"), "select o_orderkey, p_partkey from orders join part on o_totalprice between p_retailprice * 200 and p_retailprice * 200 + p_size * p_size / 20")
_add("overlap_join", lambda s, t: overlap_join(t("events").where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("a0"), F.expr("ts + interval 1 hour").alias("a1")), _KIND(t, "error").select(F.col("event_id").alias("other"), F.col("user_id").alias("u"), F.expr("ts - interval 30 minutes").alias("b0"), F.expr("ts + interval 30 minutes").alias("b1")), ("a0", "a1"), ("b0", "b1"), [("user_id", "u")]).select("event_id", "other"), "select a.event_id, b.event_id as other from events a join events b on a.event_type = 'purchase' and b.event_type = 'error' and a.user_id = b.user_id and a.ts <= b.ts + interval 30 minutes and b.ts - interval 30 minutes <= a.ts + interval 1 hour")
_add("theta_join", lambda s, t: theta_join(t("supplier"), t("customer"), "s_acctbal", "<", "c_acctbal", [("s_nationkey", "c_nationkey")]).select("s_suppkey", "c_custkey"), "select s_suppkey, c_custkey from supplier join customer on s_nationkey = c_nationkey and s_acctbal < c_acctbal")
_add("range_join", lambda s, t: range_join(t("events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at")), t("events").where("event_type = 'error'").select(F.col("user_id").alias("u"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("lo"), (F.unix_timestamp(F.col("ts").cast("timestamp")) + 3600).alias("hi"), F.col("event_id").alias("error_id")), [("user_id", "u")], "at", "lo", "hi").select("event_id", "error_id"), "select a.event_id, b.event_id as error_id from events a join events b on a.user_id = b.user_id and b.event_type = 'error' and floor(epoch(a.ts)) between floor(epoch(b.ts)) and floor(epoch(b.ts)) + 3600")
_add("merge_labels", lambda s, t: merge([("eu", t("nation").where("n_regionkey = 3"), "Europe"), ("as", t("nation").where("n_regionkey = 2"), "Asia")]), "select 'eu' as _source, 'Europe' as _label, * from nation where n_regionkey = 3 union all select 'as', 'Asia', * from nation where n_regionkey = 2")
_add("merge_no_source", lambda s, t: merge([("a", t("region")), ("b", t("region").withColumn("x", F.lit(1).cast("long")))], lineage=False), "select *, cast(null as bigint) as x from region union all select *, 1 from region")
_add("union_distinct", lambda s, t: merge([("n", t("nation").select("n_regionkey")), ("r", t("region").select(F.col("r_regionkey").alias("n_regionkey")))], lineage=False, distinct=True), "select n_regionkey from nation union select r_regionkey from region")
_ANALYZE = " union all ".join(f"select '{c}' as field, '{k}' as type, count({c}) as count, count({c}) * 100.0::double / count(*) as frequency, " + (f"min({c})::double as min, max({c})::double as max, round(sum({c}), 2)::double as sum, round(avg({c}), 4) as mean" if k == "number" else "null::double as min, null::double as max, null::double as sum, null::double as mean") + " from events" for c, k in (("event_id", "number"), ("ts", "string"), ("user_id", "number"), ("event_type", "string"), ("value", "number"), ("props", "string")))
_add("analyze_events", lambda s, t: analyze(t("events")).withColumn("sum", F.round("sum", 2)).withColumn("mean", F.round("mean", 4)), _ANALYZE)
_INSPECT = " union all ".join(f"select '{c}' as field, '{k}' as type, count(*) > count({c}) as nullable, count({c}) as count from customer" for c, k in (("c_custkey", "number"), ("c_name", "string"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "string")))
_add("inspect_customer", lambda s, t: inspect_schema(t("customer"), sample=0).drop("samples"), _INSPECT)
_add("edit_set_delete", lambda s, t: edit(t("nation"), ".tag=new", ".n_regionkey:=7", "-.n_name", merge={"meta": {"a": 1}}).select("n_nationkey", F.col("n_regionkey").cast("long").alias("n_regionkey"), "tag", "meta.a"), "select n_nationkey, 7::bigint as n_regionkey, 'new' as tag, 1::bigint as a from nation")
_add("edit_append", lambda s, t: edit(t("nation").select("n_nationkey", F.array("n_name").alias("names")), '.names+="z"', '.names^="a"', ".other+=1").select("n_nationkey", "names", "other"), "select n_nationkey, ['a', n_name, 'z'] as names, [1::bigint] as other from nation")


def _store(t) -> DataFrame:
    o = t("orders")
    at = F.col("o_orderdate").cast("timestamp")
    gone = F.col("o_orderstatus") == "F"
    return o.select("o_totalprice", F.struct((F.col("o_orderkey") - F.col("o_orderkey") % 2).cast("long").alias("id"), at.alias("created_at"), at.alias("updated_at"), gone.alias("deleted"), F.when(gone, at).alias("deleted_at"), F.lit(1).cast("long").alias("version")).alias("_meta"))


_add("docstore_visible", lambda s, t: docstore.visible(_store(t)).select("o_totalprice"), "select o_totalprice from orders where o_orderstatus <> 'F'")
_add("docstore_stats", lambda s, t: docstore.stats(_store(t)), "select count(*) as total, count(*) filter (where o_orderstatus <> 'F') as active, count(*) filter (where o_orderstatus = 'F') as deleted, max(o_orderkey - o_orderkey % 2) as max_id from orders")
_add("dup_check", lambda s, t: docstore.check(_store(t)).where("problem = 'duplicate id'").select("id", "count"), "select o_orderkey - o_orderkey % 2 as id, count(*) as count from orders group by 1 having count(*) > 1")
_add("docstore_insert", lambda s, t: docstore.insert(docstore.empty(s, "r_regionkey int, r_name string"), t("region"), ["r_regionkey"]).select("r_name", F.col("_meta.id").alias("id"), F.col("_meta.version").alias("version")), "select r_name, row_number() over (order by r_regionkey) as id, 1::bigint as version from region")


def _tasks(t) -> DataFrame:
    o = t("orders")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"), F.array((F.col("o_orderkey") + 1), (F.col("o_orderkey") * 2)).alias("blockers"), F.when(F.col("o_orderkey") > 1, F.floor(F.col("o_orderkey") / 2)).alias("parent"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("due"), F.array(F.col("o_orderpriority")).alias("tags"))


_T = "with t as (select o_orderkey as id, case when o_orderstatus = 'F' then 'completed' else 'pending' end as status, [o_orderkey + 1, o_orderkey * 2] as blockers, o_orderdate as due, o_orderpriority as tag from orders), e as (select distinct x.id from (select id, unnest(blockers) as b from t) x join t on t.id = x.b and t.status <> 'completed') "
_add("tasks_blocked", lambda s, t: tasks.blocked(_tasks(t)).select("id"), _T + "select id from t where status = 'pending' and id in (select id from e)")
_add("tasks_ready", lambda s, t: tasks.ready(_tasks(t)).select("id"), _T + "select id from t where status = 'pending' and id not in (select id from e)")
_add("tasks_due", lambda s, t: tasks.due(_tasks(t), "1998-01-01", 7).groupBy("bucket").agg(F.count("*").alias("n")), _T + "select case when due::date < date '1998-01-01' then 'overdue' when due::date <= date '1998-01-08' then 'soon' else 'upcoming' end as bucket, count(*) as n from t where status <> 'completed' group by 1")
_add("tasks_tags", lambda s, t: tasks.top_tags(_tasks(t)), _T + "select tag, count(*) as count from t group by 1 order by 2 desc, 1 limit 5")
def _todo(t) -> DataFrame:
    """Orders as tasks with all statuses, priorities, blockers and notes."""
    o, key = t("orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("skipped")
    rank = F.substring("o_orderpriority", 1, 1)
    priority = F.when(rank.isin("1", "2"), "high").when(rank == "3", "med").otherwise("low")
    return o.select(key.alias("id"), F.concat(F.lit("task "), key.cast("string")).alias("text"), status.alias("status"), priority.alias("priority"), F.when(key % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("due"), F.array("o_orderpriority", F.concat(F.lit("t"), (key % 40).cast("string"))).alias("tags"), F.array(key + 1, key * 2).alias("blockers"), F.array_repeat(F.lit("note"), (key % 3).cast("int")).alias("notes"), F.when(key > 1, F.floor(key / 2)).alias("parent"))


_TODO = "with t as (select o_orderkey as id, case o_orderstatus when 'F' then 'done' when 'O' then 'pending' else 'skipped' end as status, case when left(o_orderpriority, 1) in ('1', '2') then 'high' when left(o_orderpriority, 1) = '3' then 'med' else 'low' end as priority, case when o_orderkey % 3 > 0 then o_orderdate::date end as due, [o_orderpriority, 't' || o_orderkey % 40] as tags, [o_orderkey + 1, o_orderkey * 2] as blockers from orders), b as (select distinct x.id from (select id, unnest(blockers) as k from t) x join t on t.id = x.k and t.status = 'pending'), p as (select t.*, b.id is not null as held from t left join b on b.id = t.id), c as (select count(*) as total, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'done') as done, count(*) filter (status = 'skipped') as skipped, " + ", ".join(f"count(*) filter (status = 'pending' and {test}) as {name}" for name, test in (("high", "priority = 'high'"), ("med", "priority = 'med'"), ("low", "priority = 'low'"), ("ready", "not held"), ("blocked", "held"), ("overdue", "due < date '1997-01-01'"), ("soon", "due between date '1997-01-01' and date '1997-01-08'"), ("undated", "due is null"))) + " from p) "
_add("tasks_counts", lambda s, t: tasks.counts(_todo(t), "1997-01-01"), _TODO + "select total, pending, done, skipped, ready, blocked, overdue from c")
_add("tasks_stats", lambda s, t: tasks.stats(_todo(t), "1997-01-01").select("total", "pending", "done", "skipped", "priority.*", "workflow.*", "due.overdue", "due.soon", F.col("due.none").alias("undated"), F.array_join(F.transform("top_tags", lambda e: F.concat(e["tag"], F.lit("="), e["count"].cast("string"))), ",").alias("tags")), _TODO + "select c.*, (select string_agg(tag || '=' || n, ',' order by n desc, tag desc) from (select tag, count(*) as n from (select unnest(tags) as tag from t where status = 'pending') group by tag order by n desc, tag desc limit 5)) as tags from c")
_add("tasks_export_csv", lambda s, t: tasks.export_rows(_todo(t)).select("id", "text", "status", "tags", "blockers", F.col("notes_count").cast("long").alias("notes_count"), "parent"), "select o_orderkey as id, 'task ' || o_orderkey as text, case o_orderstatus when 'F' then 'done' when 'O' then 'pending' else 'skipped' end as status, o_orderpriority || ';t' || o_orderkey % 40 as tags, (o_orderkey + 1) || ';' || (o_orderkey * 2) as blockers, o_orderkey % 3 as notes_count, case when o_orderkey > 1 then o_orderkey // 2 end as parent from orders")
_add("tasks_export_markdown", lambda s, t: tasks.export_markdown(_todo(t), ["id"]).where("part % 2 = 0 and part > 0").select("part", "place", "line"), "select case o_orderstatus when 'O' then 2 when 'F' then 4 else 6 end as part, row_number() over (partition by o_orderstatus order by o_orderkey) as place, case o_orderstatus when 'O' then '- [ ] ' when 'F' then '- [x] ' else '- [~] ' end || 'task ' || o_orderkey || case when o_orderstatus <> 'O' then '' else case when left(o_orderpriority, 1) in ('1', '2') then ' 🔴' when left(o_orderpriority, 1) in ('4', '5') then ' 🟢' else '' end || case when o_orderkey % 3 > 0 then ' (due: ' || strftime(o_orderdate, '%Y-%m-%d') || ')' else '' end end as line from orders")
_CHAIN = "select o_orderkey as id, case when o_orderkey % 300 > 0 then o_orderkey - 1 end as parent from orders"
_add("graph_chains", lambda s, t: tasks.tree(c := t("orders").selectExpr("o_orderkey as id", "case when o_orderkey % 300 > 0 then o_orderkey - 1 end as parent"), c.where("id % 100 = 0")).groupBy("root").agg(F.count("*").alias("n"), F.max("depth").cast("long").alias("deepest")), f"with recursive c as ({_CHAIN}), r(root, id, depth) as (select id, id, 0 from c where id % 100 = 0 union all select root, c.id, depth + 1 from r join c on c.parent = r.id) select root, count(*) as n, max(depth)::bigint as deepest from r group by root")
_add("graph_tree", lambda s, t: tasks.tree(_tasks(t), _tasks(t).where("id = 1")).select("id", "depth"), "with recursive r(id, depth) as (select o_orderkey, 0 from orders where o_orderkey = 1 union all select o.o_orderkey, r.depth + 1 from r join orders o on o.o_orderkey // 2 = r.id and o.o_orderkey > 1) select id, depth from r")



def _sql_profile(s: SparkSession, t) -> DataFrame:
    t("customer").createOrReplaceTempView("customer")
    text = "select c_mktsegment as seg, count(*) as n from customer where (:seg is null or c_mktsegment = :seg) and ($min is null or c_acctbal >= cast($min as double)) group by 1"
    return run_sql(s, text, {"min": "1000"})


_add("sql_parameters", _sql_profile, "select c_mktsegment as seg, count(*) as n from customer where c_acctbal >= 1000 group by 1")
_add("file_lineage", lambda s, t: with_lineage(t("region")).select("r_regionkey", "_filename", "_basename", F.col("_ext").alias("ext")), "select r_regionkey, 'region.parquet' as _filename, 'region' as _basename, '.parquet' as ext from region")
_add("tumbling_counts", lambda s, t: tumbling_counts(t("events"), "ts", "1 hour", ["event_type"], "10 minutes").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", F.col("count").alias("n")), "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by all")


#: Second names of queries.
for _name in ("iterate_explode", "tasks_blocked", "tasks_ready", "tasks_due", "tasks_tags", "graph_tree", "join_full_indicator"):
    _QUERIES[f"{_name}_all"], _SQL[f"{_name}_all"] = _QUERIES[_name], _SQL[_name]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large orders joined to customers, by market segment, as the language says it."""
    orders = apply(_table(spark, sf_dir, "orders"), "select(.o_totalprice > 100000) | {o_custkey, o_totalprice}")
    both = join(orders, _table(spark, sf_dir, "customer"), left_key="o_custkey", right_key="c_custkey")
    grouped = slurp(both, "group_by(.c_mktsegment) | map({c_mktsegment: .[0] | .c_mktsegment, n_orders: length, total: (map(.o_totalprice) | add)}) | .[]")
    return grouped.withColumn("total", F.round("total", 2))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalogue_files

    return {"flagship": flagship} | _QUERIES | catalogue_files.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import catalogue_files

    return {"flagship": "select c_mktsegment, count(*) as n_orders, round(sum(o_totalprice), 2) as total from orders left join customer on o_custkey = c_custkey where o_totalprice > 100000 group by 1"} | _SQL | catalogue_files.SQL
