"""Queries that write small files to the shared folder and read them back, and those of stores, coverage and streams."""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import coverage, docstore, lookup, sinks, versions
from .operators import join
from .plans import apply
from .session import shared_dir
from .sources import container, load, register_records, table
from .streaming import follow, join_streams, keyed_head, keyed_numbers, keyed_profile, keyed_tail, register_lines, run_available, running_counts, session_counts, sliding_counts, use_state_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def register(build: Callable[[SparkSession, Callable[[str], DataFrame], str], DataFrame]):
        """build gets (spark, table by name, a new folder)."""
        QUERIES[name] = lambda spark, sf_dir: build(spark, lambda t: load(spark, f"{sf_dir}/{t}.parquet"), f"{shared_dir(spark)}/recordflow-files-{uuid.uuid4().hex}")
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def _values(names: str, *rows: str) -> str:
    return f"select * from (values {', '.join(f'({r})' for r in rows)}) as v({names})"


def _both_ways(name: str, ending: str, table: str, columns: str, sql: str, **options) -> None:
    """A table written in a format and read back; columns casts what the format keeps as text."""

    def build(spark, t, folder):
        sinks.save(t(table), f"{folder}/{table}.{ending}", **options)
        return load(spark, f"{folder}/{table}.{ending}").selectExpr(*columns.split(", "))

    _query(f"file_{name}", sql)(build)


_NATION = "cast(n_nationkey as bigint) n_nationkey, n_name, cast(n_regionkey as bigint) n_regionkey"
_NATION_SQL = "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation"
for _name, _ending in (("csv", "csv"), ("csv_gzip", "csv.gz"), ("tsv", "tsv"), ("jsonl", "jsonl"), ("jsonl_gzip", "jsonl.gz"), ("json", "json"), ("yaml", "yaml"), ("xlsx", "xlsx"), ("table", "table"), ("parquet", "parquet"), ("orc", "orc")):
    _both_ways(_name, _ending, "nation", _NATION, _NATION_SQL)
_both_ways("csv_customers", "csv", "customer", "cast(c_custkey as bigint) c_custkey, c_name, cast(c_acctbal as double) c_acctbal", "select c_custkey, c_name, c_acctbal from customer")
_both_ways("jsonl_documents", "jsonl.gz", "documents", "doc_id, text, lang, source, n_chars", "select doc_id, text, lang, source, n_chars from documents")


@_query("file_xml", "select 'n_name' as tag, n_name as text from nation")
def _(spark, t, folder):
    sinks.save(t("nation"), f"{folder}/n.xml")
    return load(spark, f"{folder}/n.xml").where("tag = 'n_name'").select("tag", "text")


def _csv_text(rows: DataFrame, line: str, path: str, order: str, head: str | None = None) -> None:
    """Lines made of a table's rows, in order: a file for each range of them, each with the head, so no task sorts the whole table."""

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        led = False
        for batch in batches:
            if batch.num_rows and not led:
                led = True
                if batch.column("at")[0].is_valid:  # the first range has it as a row
                    yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
            yield pa.RecordBatch.from_arrays([batch.column("value")], names=["value"])

    made = rows.select(F.col(order).cast("long").alias("at"), F.expr(line).alias("value"))
    if head is not None:
        made = made.unionAll(rows.sparkSession.createDataFrame([(None, head)], "at long, value string"))
    made = made.repartitionByRange("at").sortWithinPartitions("at")
    (made.select("value") if head is None else made.mapInArrow(headed, "value string")).write.text(path)


def _text(rows: DataFrame, line: str, path: str, order: str, head: str | None = None, end: str | None = None, each: bool = False, **options) -> None:
    """Text made of a table's rows, in order: one file, or (each) a file for each row."""
    made = rows.select(F.lit(1).alias("part"), F.col(order).cast("long").alias("at"), F.expr(line).alias("value"))
    for part, text in ((0, head), (2, end)):
        if text is not None:
            made = made.unionAll(rows.sparkSession.createDataFrame([(part, 0, text)], "part int, at long, value string"))
    sorted_ = made.repartition(1).sortWithinPartitions("part", "at").select("value")
    sorted_.write.options(**options | ({"maxRecordsPerFile": "1"} if each else {})).text(path)


@_query("file_xml_tree", "select 'user' as tag, n_name as name from nation")
def _(spark, t, folder):
    _text(t("nation"), "concat('<user id=\"', n_nationkey, '\"><name>', n_name, '</name></user>')", f"{folder}/in.xml", "n_nationkey", "<users>", "</users>")
    sinks.save(load(spark, f"{folder}/in.xml?mode=tree"), f"{folder}/out.xml?mode=tree")
    return apply(load(spark, f"{folder}/out.xml?mode=tree"), ".children | .[] | {tag, name: .children[0].text}")


@_query("file_xml_by_tag", "select cast(n_nationkey as varchar) as id, n_name as name from nation")
def _(spark, t, folder):
    _text(t("nation"), "concat('<user id=\"', n_nationkey, '\"><name>', n_name, '</name></user>')", f"{folder}/in.xml", "n_nationkey", each=True)
    return load(spark, f"{folder}/in.xml?mode=xmltodict").selectExpr("user.`@id` as id", "user.name as name")


@_query("table_container", _values('"table", kind, columns', "'listed_nation', 'view', 3::bigint", "'listed_region', 'view', 2"))
def _(spark, t, folder):
    for name in ("nation", "region"):
        t(name).createOrReplaceTempView(f"listed_{name}")
    return container(spark).where("table like 'listed\\\\_%'")


@_query("table_records", "select r_name from region where r_regionkey > 0")
def _(spark, t, folder):
    t("region").createOrReplaceTempView("listed_region")
    return apply(table(spark, "listed_region"), "select(.r_regionkey > 0) | {r_name}")


@_query("file_csv_long_rows", "select cast(o_orderkey as varchar) as a, case when o_orderkey % 5 < 4 then cast(o_custkey as varchar) end as b, case when o_orderkey % 5 between 2 and 3 then 'x' || o_orderkey end as _extra0, case when o_orderkey % 5 = 3 then 'y' end as _extra1 from orders")
def _(spark, t, folder):
    _csv_text(t("orders"), "concat_ws(',', o_orderkey, if(o_orderkey % 5 < 4, string(o_custkey), null), if(o_orderkey % 5 in (2, 3), concat('x', o_orderkey), null), if(o_orderkey % 5 = 3, 'y', null))", f"{folder}/x.csv", "o_orderkey", "a,b")
    return load(spark, f"{folder}/x.csv")


@_query("file_csv_sniffed", "select c_name || ';\"' || c_mktsegment as name, cast(c_custkey as varchar) as key from customer")
def _(spark, t, folder):
    _csv_text(t("customer"), "concat('\"', c_name, ';\"\"', c_mktsegment, '\";', c_custkey)", f"{folder}/x.csv", "c_custkey", "name;key")
    return load(spark, f"{folder}/x.csv")


@_query("file_csv_no_header", "select c_name as col0, cast(c_custkey as varchar) as col1 from customer")
def _(spark, t, folder):
    _csv_text(t("customer"), "concat(c_name, ',', c_custkey)", f"{folder}/x.csv", "c_custkey")
    return load(spark, f"{folder}/x.csv?header=false")


@_query("file_glob_lineage", "select '.json' as _ext, case event_type when 'click' then 0 when 'error' then 1 else 2 end::bigint as _file_index, row_number() over (partition by event_type order by event_id) - 1 as _line_index, event_id from events where event_type in ('click', 'error', 'view')")
def _(spark, t, folder):
    for place, kind in (("2024/00", "click"), ("2024/01", "error"), ("2025", "view")):
        t("events").where(f"event_type = '{kind}'").select("event_id").orderBy("event_id").coalesce(1).write.json(f"{folder}/{place}")
    return load(spark, f"{folder}/**/*.json~jsonl", index=True).select("_ext", "_file_index", "_line_index", "event_id")


@_query("file_glob_csv", "select case when c_custkey % 3 = 0 then 'x' else 'y/z' end as place, cast(c_custkey as varchar) as c_custkey, c_name from customer where c_custkey % 3 < 2")
def _(spark, t, folder):
    for k, place in enumerate(("x/logs", "y/z/logs", "y/other")):
        t("customer").where(f"c_custkey % 3 = {k}").select("c_custkey", "c_name").write.option("header", "true").csv(f"{folder}/{place}")
    return load(spark, f"{folder}/**/logs/*.csv", lineage=True).select(F.regexp_extract("_dir", "/(x|y/z)/logs$", 1).alias("place"), "c_custkey", "c_name")


@_query("file_yaml_gzip", "select r_regionkey::bigint as _file_index, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as _line_index, n_nationkey::bigint as x, [n_name, r_name] as tags from nation join region on n_regionkey = r_regionkey")
def _(spark, t, folder):
    both = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    for k in range(5):  # a file for each region
        _text(both.where(f"r_regionkey = {k}"), "concat('- x: ', n_nationkey, '\n  tags: [', n_name, ', ', r_name, ']')", f"{folder}/{k}", "n_nationkey", compression="gzip")
    return load(spark, f"{folder}/**/*.txt.gz~yaml", index=True).select("_file_index", "_line_index", "x", "tags")


@_query("file_toml", "select n_name as title, 8000 + n_nationkey::bigint as port from nation")
def _(spark, t, folder):
    _text(t("nation"), "concat('title = \"', n_name, '\"\n[server]\nport = ', 8000 + n_nationkey)", f"{folder}/x.toml", "n_nationkey", each=True)
    return apply(load(spark, f"{folder}/x.toml"), "{title, port: .server.port}")


@_query("file_markdown", "select 'content' as type, '# ' || n_name || chr(10) || 'body ' || n_nationkey as content from nation union all select 'frontmatter', null from nation")
def _(spark, t, folder):
    _text(t("nation"), "concat('---\ntitle: ', n_name, '\n---\n# ', n_name, '\nbody ', n_nationkey, '\n')", f"{folder}/x.md", "n_nationkey", each=True)
    return load(spark, f"{folder}/x.md").select("type", "content")


def _covered(t, folder: str) -> str:
    """Coverage of a made-up source file for each nation: its key says how often lines, functions and branches ran."""
    record = "concat_ws('\n', concat('SF:', n_name, '.py'), 'FN:1,3,f', 'FN:5,g', concat('FNDA:', n_nationkey, ',f'), 'FNDA:0,g', concat('DA:1,', n_nationkey % 2), 'DA:2,2', 'DA:3,0', concat('DA:5,', n_nationkey % 3), 'DA:6,0', concat('BRDA:2,0,0,', n_nationkey), 'BRDA:2,0,1,-', 'end_of_record', concat('SF:', n_name, '_b.py'), 'DA:1,0', 'end_of_record')"
    _text(t("nation"), record, f"{folder}/x.lcov", "n_nationkey", each=True)
    return f"{folder}/x.lcov"


_HITS = "1 + (n_nationkey % 2 > 0)::int + (n_nationkey % 3 > 0)::int"


@_query("coverage_files", f"select n_name || '.py' as file, 5::bigint as lines, ({_HITS})::bigint as hit_lines, 2::bigint as branches, (n_nationkey > 0)::bigint as hit_branches, ({_HITS}) / 5::double as line_share, (n_nationkey > 0)::int / 2::double as branch_share from nation union all select n_name || '_b.py', 1, 0, 0, 0, 0.0, null from nation")
def _(spark, t, folder):
    return coverage.files(load(spark, _covered(t, folder)))


@_query("coverage_functions", "select n_name || '.py' as file, 'f' as name, n_nationkey::bigint as calls, 3::bigint as lines, (1 + (n_nationkey % 2 > 0)::int)::bigint as hit_lines from nation union all select n_name || '.py', 'g', 0, 2, (n_nationkey % 3 > 0)::bigint from nation")
def _(spark, t, folder):
    return coverage.functions(load(spark, _covered(t, folder))).select("file", "name", "calls", "lines", "hit_lines")


@_query("call_counts", "select event_type as callee, count(distinct user_id) as callers from events group by 1")
def _(spark, t, folder):
    return coverage.call_counts(t("events").select(F.col("user_id").alias("caller"), F.col("event_type").alias("callee")))


# joins on both sides' surplus, arrays


@_query("join_right", "select o_custkey as c_custkey, c_name, o_orderkey from customer right join orders on c_custkey = o_custkey")
def _(spark, t, folder):
    return join(t("customer").select("c_custkey", "c_name"), t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), on="c_custkey", how="right")


@_query("join_full", "select coalesce(d.doc_id, l.doc_id) as doc_id, lang, quality from documents d full join labels l on d.doc_id = l.doc_id")
def _(spark, t, folder):
    return join(t("documents").select("doc_id", "lang"), t("labels").select("doc_id", "quality"), on="doc_id", how="full")


@_query("array_construct", "select o_orderkey, [o_orderkey, o_custkey] as pair, 2::bigint as n from orders")
def _(spark, t, folder):
    return apply(t("orders"), "{o_orderkey, pair: [.o_orderkey, .o_custkey], n: ([.o_orderkey, .o_custkey] | length)}")


@_query("array_flatten", "select o_orderkey, [o_orderkey, o_custkey, 7] as f from orders")
def _(spark, t, folder):
    return apply(t("orders"), "{o_orderkey, f: ([[.o_orderkey, .o_custkey], [7]] | flatten)}")


@_query("string_chars", "select n_nationkey, list_filter(string_split(n_name, ''), lambda c: c <> '') as c from nation")
def _(spark, t, folder):
    return apply(t("nation"), "{n_nationkey, c: (.n_name | chars)}")


@_query("math_limits", "select o_orderkey as k, case o_orderkey % 3 when 0 then -9223372036854775807::bigint when 2 then o_custkey + 1 end as i, case o_orderkey % 3 when 1 then 9223372036854775806::bigint when 2 then o_custkey - 1 end as d, case o_orderkey % 3 when 1 then 9223372036854775807::bigint when 2 then o_custkey end as a, case o_orderkey % 3 when 1 then -9223372036854775807::bigint when 2 then -o_custkey end as n from orders")
def _(spark, t, folder):
    # one more, one less, size and sign of the least and the largest whole numbers: null where there is none
    made = t("orders").selectExpr("o_orderkey k", "case o_orderkey % 3 when 0 then -9223372036854775807 - 1 when 1 then 9223372036854775807 else o_custkey end v")
    return apply(made, "{k, i: (.v|incr), d: (.v|decr), a: (.v|abs), n: (.v|negate)}")


@_query("object_values", "select n_nationkey, ['1', '\"' || n_name || '\"', 'null'] as v from nation")
def _(spark, t, folder):
    return apply(t("nation"), "{n_nationkey, v: ({a: 1, b: .n_name, c: null} | values)}")


# document store


def _store(spark: SparkSession, t) -> DataFrame:
    return docstore.insert(docstore.empty(spark, "n_nationkey int, n_name string, n_regionkey int"), t("nation"), ["n_nationkey"])


@_query("docstore_update", "select n_name, case when n_nationkey = 4 then 9::bigint else n_regionkey::bigint end as n_regionkey, case when n_nationkey = 4 then 2 else 1 end::bigint as version from nation")
def _(spark, t, folder):
    return docstore.update(_store(spark, t), 5, ".n_regionkey:=9").select("n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"), F.col("_meta.version").alias("version"))


@_query("docstore_delete", "select n_name, n_nationkey = 2 as deleted, case when n_nationkey = 2 then 2 else 1 end::bigint as version from nation")
def _(spark, t, folder):
    return docstore.delete(_store(spark, t), 3).select("n_name", F.col("_meta.deleted").alias("deleted"), F.col("_meta.version").alias("version"))


@_query("docstore_undelete", "select n_name, false as deleted from nation")
def _(spark, t, folder):
    return docstore.undelete(docstore.delete(_store(spark, t), 3), 3).select("n_name", F.col("_meta.deleted").alias("deleted"))


@_query("docstore_purge", "select n_name from nation where n_nationkey <> 2")
def _(spark, t, folder):
    return docstore.purge(docstore.delete(_store(spark, t), 3)).select("n_name")


@_query("docstore_write_undo", "select n_name from nation")
def _(spark, t, folder):
    store = _store(spark, t)
    docstore.write(store, f"{folder}/store")
    docstore.write(docstore.purge(docstore.delete(store, 3)), f"{folder}/store")
    return docstore.undo(spark, f"{folder}/store").select("n_name")


@_query("docstore_repair", "select min(o_orderkey) as first from orders group by o_custkey")
def _(spark, t, folder):
    o = t("orders")
    at = F.timestamp_seconds("o_orderkey")
    store = o.select(F.col("o_orderkey").alias("first"), F.struct(F.col("o_custkey").alias("id"), at.alias("created_at"), at.alias("updated_at"), F.lit(False).alias("deleted"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(1).cast("long").alias("version")).alias("_meta"))
    return docstore.repair(store)[0].select("first")


@_query("docstore_reindex", "select n_name, row_number() over (order by n_nationkey) as id, case when n_nationkey < 2 then 1 else 2 end::bigint as version from nation where n_nationkey <> 2")
def _(spark, t, folder):
    return docstore.reindex(docstore.purge(docstore.delete(_store(spark, t), 3))).select("n_name", F.col("_meta.id").alias("id"), F.col("_meta.version").alias("version"))


@_query("docstore_export", "select n_nationkey + 1::bigint as id, false as deleted, '{\"n_name\":\"' || n_name || '\"}' as data from nation")
def _(spark, t, folder):
    return docstore.export_rows(_store(spark, t).drop("n_nationkey", "n_regionkey")).select("id", "deleted", "data")


# a persistent index


@_query("lookup_join", "select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey")
def _(spark, t, folder):
    lookup.build(t("orders"), "o_custkey", folder, block_rows=5000)
    return lookup.indexed_join(t("customer"), folder, "c_custkey", "o_custkey").select("c_custkey", "o_orderkey")


# versions of a store, and what changed


def _versions(spark, t, folder) -> versions.Store:
    store = versions.Store(spark, folder, file_rows=4000)
    store.insert(t("orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    store.update(10, ".o_orderstatus=X")
    store.delete(11)
    return store


_FIRST = "select o_orderkey, row_number() over (order by o_orderkey) as id, o_orderstatus from orders"


@_query("versions_latest", f"select o_orderkey, case when id = 10 then 'X' else o_orderstatus end as o_orderstatus, id = 11 as deleted, case when id in (10, 11) then 2 else 1 end::bigint as version from ({_FIRST})")
def _(spark, t, folder):
    return _versions(spark, t, folder).read().select("o_orderkey", "o_orderstatus", "_meta.deleted", "_meta.version")


@_query("versions_earlier", f"select o_orderkey, case when id = 10 then 'X' else o_orderstatus end as o_orderstatus from ({_FIRST})")
def _(spark, t, folder):
    return _versions(spark, t, folder).read(2).select("o_orderkey", "o_orderstatus")


_EDITED = "select o_orderkey, o_custkey, case when o_orderkey % 83 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice, case when o_orderkey % 89 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders where o_orderkey % 97 > 0 union all select -o_orderkey - 1, o_custkey, o_totalprice, o_orderstatus from orders where o_orderkey % 101 = 0"


@_query("table_changes", f"with n as ({_EDITED}), c as (select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, case when o.o_orderkey is null then 'added' when n.o_orderkey is null then 'removed' when o.o_totalprice <> n.o_totalprice or o.o_orderstatus <> n.o_orderstatus then 'changed' end as change, concat_ws(',', case when o.o_totalprice <> n.o_totalprice then 'o_totalprice' end, case when o.o_orderstatus <> n.o_orderstatus then 'o_orderstatus' end) as columns from orders o full join n on o.o_orderkey = n.o_orderkey) select o_orderkey, change, case when change = 'changed' then columns end as columns from c where change is not null")
def _(spark, t, folder):
    orders = t("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    edited = spark.sql(_EDITED.replace("from orders", "from {orders}"), orders=orders)
    return versions.changes(orders, edited, ["o_orderkey"]).withColumn("columns", F.array_join("columns", ","))


# a format of its own and a table function


@_query("records_pushed", "select o_orderkey, o_orderstatus, o_totalprice from orders where o_totalprice > 400000 and o_orderstatus in ('F', 'O')")
def _(spark, t, folder):
    register_records(spark)
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows.repartitionByRange("o_totalprice").write.format("records").mode("append").save(folder)
    return spark.read.format("records").option("push", "true").load(folder).where("o_totalprice > 400000 and o_orderstatus in ('F', 'O')")


@_query("table_function_sessions", "with b as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 1800 seconds then 0 else 1 end as new from events) select event_id as id, cast(sum(new) over (partition by user_id order by ts) as integer) as session from b")
def _(spark, t, folder):
    register_records(spark)
    events = t("events").select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return spark.sql("select id, session from sessions(table({rows}) partition by user_id order by (at), 1800)", rows=events)


# streams: all that is available now, from files, into a table


def _stream(spark: SparkSession, rows: DataFrame, folder: str, name: str = "in") -> DataFrame:
    rows.write.json(f"{folder}/{name}")
    return follow(spark, f"{folder}/{name}", rows.schema)


def _events(spark: SparkSession, t, folder: str) -> DataFrame:
    return _stream(spark, t("events").select("event_id", "user_id", "event_type", "value", "ts"), folder)


@_query("stream_filter", "select event_id, value * 2 as v from events where event_type = 'error'")
def _(spark, t, folder):
    return run_available(apply(_events(spark, t, folder), 'select(.event_type == "error") | {event_id, v: (.value * 2)}'), f"{folder}/out")


@_query("stream_running_counts", "select event_type, count(*) as n from events group by 1")
def _(spark, t, folder):
    return run_available(running_counts(_events(spark, t, folder), ["event_type"]), f"{folder}/out", "complete").select("event_type", F.col("count").alias("n"))


@_query("stream_followed_lines", "select event_id, user_id from events")
def _(spark, t, folder):
    register_lines(spark)
    t("events").select("event_id", "user_id").write.json(f"{folder}/in")
    lines = spark.readStream.format("lines").option("chunk", "65536").load(f"{folder}/in/part-*.json")
    return run_available(lines.select(F.from_json("line", "event_id bigint, user_id bigint").alias("r")).select("r.*"), f"{folder}/out")


@_query("stream_keyed_numbers", "select event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events")
def _(spark, t, folder):
    use_state_store(spark)
    return run_available(keyed_numbers(_events(spark, t, folder), ["user_id"], ["ts", "event_id"]), f"{folder}/out").select("event_id", "seq")


@_query("stream_keyed_head", "select event_id, k as seq from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k <= 3")
def _(spark, t, folder):
    use_state_store(spark)
    return run_available(keyed_head(_events(spark, t, folder), ["user_id"], 3, ["ts", "event_id"]), f"{folder}/out").select("event_id", "seq")


@_query("stream_keyed_tail", "select event_id, least(n, 4) + 1 - k as place from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k, count(*) over (partition by user_id) as n from events) where k <= 4")
def _(spark, t, folder):
    use_state_store(spark)
    stream = _events(spark, t, folder).select("event_id", "user_id", "ts")
    return run_available(keyed_tail(stream, ["user_id"], 4, ["ts", "event_id"]), f"{folder}/out", "update", ["user_id"]).select("event_id", "place")


@_query("stream_keyed_profile", "select event_type, count(*) as records, count(value) as count, min(value) as min, max(value) as max, cast(round(sum(value) * 100) as bigint) as cents from events group by 1")
def _(spark, t, folder):
    use_state_store(spark)
    out = run_available(keyed_profile(_events(spark, t, folder), ["event_type"], ["value"]), f"{folder}/out", "update", ["event_type"])
    return out.select("event_type", "records", "count", "min", "max", F.round(F.col("sum") * 100).cast("long").alias("cents"))


_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_SHOWN = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
#: Windows that have ended by the watermark; later ones are still open.
_DONE = "(select max(ts) from events) - interval 10 minutes"


@_query("stream_sliding_counts", f"with w as (select date_trunc('hour', ts) - to_hours(unnest(range(0, 3))::bigint) as s, event_type from events) select {_TIME.format('s')} as start, {_TIME.format('s + interval 3 hours')} as end, event_type, count(*) as n from w where s + interval 3 hours <= {_DONE} group by s, event_type")
def _(spark, t, folder):
    out = run_available(sliding_counts(_events(spark, t, folder), "ts", "3 hours", "1 hour", ["event_type"], "10 minutes"), f"{folder}/out")
    return out.select(_SHOWN("start"), _SHOWN("end"), "event_type", F.col("count").alias("n"))


@_query("stream_sessions", f"with b as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 45 minutes then 0 else 1 end as new from events), g as (select *, sum(new) over (partition by user_id order by ts) as s from b) select {_TIME.format('min(ts)')} as start, user_id, count(*) as n from g group by user_id, s having max(ts) + interval 45 minutes <= {_DONE}")
def _(spark, t, folder):
    return run_available(session_counts(_events(spark, t, folder), "ts", "45 minutes", ["user_id"], "10 minutes"), f"{folder}/out").select(_SHOWN("start"), "user_id", F.col("count").alias("n"))


@_query("stream_join", "select a.event_id, b.event_id as other from events a join events b on a.event_type = 'view' and b.event_type = 'click' and a.user_id = b.user_id and b.ts between a.ts - interval 5 minutes and a.ts + interval 1 hour")
def _(spark, t, folder):
    rows = t("events").select("event_id", "user_id", "event_type", "ts")
    views, clicks = (_stream(spark, rows.where(f"event_type = '{k}'"), folder, k) for k in ("view", "click"))
    joined = join_streams(views, clicks, [("user_id", "user_id")], "ts", "ts", "5 minutes", "1 hour", "2 hours")
    return run_available(joined, f"{folder}/out").select("event_id", F.col("event_id_right").alias("other"))


__all__ = ["QUERIES", "SQL"]
