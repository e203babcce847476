"""load(): any address as a DataFrame."""

from __future__ import annotations

import json
import re
import sys
import urllib.parse
import urllib.request

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..address import Address, parse_address
from ..operators import inspect_schema
from ..plans import apply
from ..profiles import Profiles, run_sql
from .documents import PARSERS, records

#: Columns that tell where a record of a document stands, until lineage is added or they are dropped.
_PLACE = ("_in_path", "_in_name", "_in_line")
SEPARATORS = {"auto": None, "tab": "\t", "comma": ",", "semicolon": ";", "pipe": "|"}


def sniff(lines: list[str]) -> str:
    """The delimiter of up to 50 lines: frequent, with an even number of columns; comma if nothing is sure."""
    best, found = 0.0, ","
    rows = [x for x in lines[:50] if x.strip()]
    for sep in (",", ";", "\t", "|"):
        columns = [x.count(sep) + 1 for x in rows if sep in x]
        if len(columns) < 3:
            continue
        mean = sum(columns) / len(columns)
        spread = sum((c - mean) ** 2 for c in columns) / len(columns)
        empty = sum(p == "" for x in rows for p in x.split(sep)) / max(1, sum(columns))
        score = len(columns) - 5 * spread - 2 * empty * len(columns)
        if score > best:
            best, found = score, sep
    return found


def _separators(line: str | Column, sep: str) -> Column:
    """How many separators of a line can end a value, those in quoted values left out."""
    s = re.escape(sep)
    bare = F.regexp_replace(line, f'(^|{s})[ \\t]*"(?:[^"]|"")*"[ \\t]*(?=$|{s})', "$1")
    return F.size(F.split(bare, s)) - 1


def _ragged(reader: DataFrameReader, source, lines: DataFrame, sep: str, header: bool) -> DataFrame:
    """Rows longer than the first have their surplus values in _extra0, _extra1, ... (without a header, in further colN)."""
    out = reader.csv(source)
    names = out.columns if header else [f"col{k}" for k in range(len(out.columns))]
    most = (lines.agg(F.max(_separators("value", sep))).first()[0] or 0) + 1
    more = [f"_extra{k}" if header else f"col{len(names) + k}" for k in range(max(0, most - len(names)))]
    if not names or not more:
        return out if header else out.toDF(*names)
    reader = reader.option("maxColumns", max(20480, most))
    schema = lambda extra: T.StructType([T.StructField(n, T.StringType()) for n in [*names, *extra]])
    last = reader.schema(schema(more)).csv(source).agg(F.max(F.greatest(F.lit(0), *(F.when(F.col(f"`{n}`").isNotNull(), k + 1) for k, n in enumerate(more))))).first()[0]
    return reader.schema(schema(more[: last or 0])).csv(source)


def _csv(spark: SparkSession, path: str, options: dict, files: dict[str, str]) -> DataFrame:
    """All values are text; a missing trailing value is null; without a header columns are col0, col1, ...; surplus values are _extra0, ..."""
    sep = options.get("delimiter", "auto")
    lines = spark.read.options(**files).text(path)
    sep = SEPARATORS.get(sep, sep) or sniff([r.value for r in lines.limit(50).collect()])
    header = str(options.get("header", "true")).lower() != "false" and "no-header" not in options
    reader = spark.read.options(**files).options(sep=sep, quote='"', escape='"', inferSchema="false", header=str(header).lower(), mode="PERMISSIVE", emptyValue="")
    return _ragged(reader, path, lines, sep, header)


def _unpacked(data: bytes) -> bytes:
    """A file's bytes, decompressed if they begin like gzip, bzip2 or zstd."""
    if data.startswith(b"\x1f\x8b"):
        import gzip

        return gzip.decompress(data)
    if data.startswith(b"BZh"):
        import bz2

        return bz2.decompress(data)
    if data.startswith(b"\x28\xb5\x2f\xfd"):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data


def _documents(spark: SparkSession, path: str, name: str, options: dict, files: dict[str, str]) -> DataFrame:
    """A whole-document format: files are parsed on the executors, the records' schema is inferred by Spark.

    Each record keeps its file and its number in it in the columns of _PLACE.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, k, x) for n, data in enumerate(batch.column("content").to_pylist()) for k, x in enumerate(records(name, _unpacked(data), options))]
            own = pa.array([n for n, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x for _, _, x in found], pa.string()), batch.column("_in_path").take(own), batch.column("_in_name").take(own), pa.array([k for _, k, _ in found], pa.int64())], names=["value", *_PLACE])

    content = spark.read.options(**files).format("binaryFile").load(path).select("content", F.col("_metadata.file_path").alias("_in_path"), F.col("_metadata.file_name").alias("_in_name"))
    text = content.mapInArrow(run, "value string, _in_path string, _in_name string, _in_line bigint")
    kind = _inferred(text)
    if not len(kind):
        return text.where("false")
    return text.select(F.from_json("value", kind).alias("r"), *_PLACE).select("r.*", *_PLACE)


def _inferred(text: DataFrame) -> T.StructType:
    """One schema for all records: a type for each name, text where types differ."""
    types = text.select(F.explode(F.from_json("value", "map<string,variant>")).alias("k", "v")).select("k", F.schema_of_variant("v").alias("t")).distinct().collect()
    merged: dict[str, set[str]] = {}
    for r in types:
        merged.setdefault(r.k, set()).add(r.t)
    order = json_order(text)
    out = T.StructType()
    for name in sorted(merged, key=lambda n: order.get(n, len(order))):
        kinds = merged[name] - {"VOID"}
        numbers = {t for t in kinds if t == "BIGINT" or t.startswith("DECIMAL") or t == "DOUBLE"}
        if not kinds:
            kind: T.DataType = T.StringType()
        elif kinds == numbers:
            kind = T.LongType() if kinds == {"BIGINT"} else T.DoubleType()
        elif kinds == {"BOOLEAN"}:
            kind = T.BooleanType()
        elif all(t.startswith(("OBJECT", "ARRAY")) for t in kinds) and len(kinds) == 1 and "VOID" not in next(iter(kinds)):
            kind = _variant_type(next(iter(kinds)))
        else:
            kind = T.StringType()
        out.add(name, kind)
    return out


def _variant_type(text: str) -> T.DataType:
    return T._parse_datatype_string(text.replace("OBJECT<", "STRUCT<").replace("DECIMAL(1,0)", "DOUBLE"))


def json_order(text: DataFrame) -> dict[str, int]:
    """Names in the order of the first record that has them."""
    names: list[str] = []
    for (keys,) in text.select(F.json_object_keys("value")).limit(100).collect():
        names += [k for k in keys or [] if k not in names]
    return {n: k for k, n in enumerate(names)}


def _text_records(spark: SparkSession, lines: list[str], name: str, options: dict) -> DataFrame:
    """Records of text that the driver has: standard input, a URL, a command's output."""
    if name in PARSERS:
        lines = records(name, "\n".join(lines).encode(), options)
    elif name == "csv":
        sep = SEPARATORS.get(options.get("delimiter", "auto"), options.get("delimiter")) or sniff(lines)
        lines = [x for x in lines if x.strip()]
        reader = spark.read.options(sep=sep, quote='"', escape='"', header="true")
        return _ragged(reader, spark.sparkContext.parallelize(lines), spark.createDataFrame([(x,) for x in lines], "value string"), sep, True)
    elif name == "json":
        doc = json.loads("\n".join(lines))
        lines = [json.dumps(x) for x in (doc if isinstance(doc, list) else [doc])]
    return spark.read.json(spark.sparkContext.parallelize([x for x in lines if x.strip()]))


def with_lineage(df: DataFrame, index: bool = False) -> DataFrame:
    """Prepends _path, _dir, _filename, _basename, _ext of each record's file; with index also _file_index and _line_index, from 0.

    Files are numbered by path.  Lines are numbered within the blocks that tasks read,
    after the counts of the file's blocks before, so a large file is not one task.
    """
    document = all(c in df.columns for c in _PLACE)
    path, name = (F.col(c) for c in (_PLACE[:2] if document else ("_metadata.file_path", "_metadata.file_name")))
    columns = [c for c in df.columns if c not in _PLACE]
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    front = [path.alias("_path"), F.regexp_replace(path, "/[^/]*$", "").alias("_dir"), name.alias("_filename"), F.regexp_replace(name, r"\.[^.]*$", "").alias("_basename"), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise("").alias("_ext")]
    if not index:
        return df.select(*front, *(F.col(f"`{c}`") for c in columns))
    place = [F.lit(0).cast("long").alias("_block"), F.col("_in_line").alias("_order")] if document else [F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_order")]
    rows = df.select(*front, *place, F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"))
    blocks = rows.groupBy(F.col("_path").alias("_p"), F.col("_block").alias("_b")).count()
    paths = blocks.select("_p").distinct().select("_p", (F.row_number().over(Window.orderBy("_p")) - 1).cast("long").alias("_file_index"))  # a row for each file
    before = blocks.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("_path", "_block").orderBy("_order")) - 1
    out = rows.withColumn("_own", own).join(before, (F.col("_path") == F.col("_p")) & (F.col("_block") == F.col("_b"))).drop("_p").join(paths, F.col("_path") == F.col("_p"))
    return out.select("_path", "_dir", "_filename", "_basename", "_ext", "_file_index", (F.col("_before") + F.col("_own")).cast("long").alias("_line_index"), "_row.*")


def _found(path: str) -> tuple[str, dict[str, str], str | None]:
    """A path with ** as its folder, the reader's options, and a pattern of whole paths where names alone don't say it."""
    base, _, rest = path.partition("**")
    rest = rest.lstrip("/") or "*"
    files = {"recursiveFileLookup": "true", "pathGlobFilter": rest.rsplit("/", 1)[-1]}
    if "/" not in rest:
        return base or ".", files, None
    inner = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in re.sub(r"\*\*/?", "\0", rest)).replace("\0", "(?:.*/)?")
    return base or ".", files, f"/(?:.*/)?{inner}$"


def load(spark: SparkSession, address: str | Address, lineage: bool = False, profiles: Profiles | None = None, headers: dict[str, str] | None = None, index: bool = False, **options) -> DataFrame:
    """Records of a file, glob, URL, profile or standard input; options override the address's.

    lineage adds the columns of each record's file, index with it the numbers of file and line.
    """
    a = parse_address(address) if isinstance(address, str) else address
    options = {**a.params, **{k.replace("_", "-") if k == "no_header" else k: v for k, v in options.items()}}
    if a.kind == "profile":
        if profiles is None:
            raise ValueError("profiles are needed for " + a.raw)
        return load_profile(spark, profiles, a.path, a.params)
    if a.kind == "stdin":
        return _text_records(spark, sys.stdin.read().splitlines(), a.format, options)
    if a.kind == "url":
        request = urllib.request.Request(a.path, headers=headers or {})
        with urllib.request.urlopen(request, timeout=60) as response:
            data = response.read()
        if a.compression == "gzip":
            import gzip

            data = gzip.decompress(data)
        return _text_records(spark, data.decode().splitlines(), a.format, options)
    name = a.format or options.get("format")
    if name is None:
        raise ValueError(f"no format for {a.raw!r}; append ~format")
    if a.compression == "xz":
        raise ValueError("xz is not a codec of Spark")
    path, files, whole = _found(a.path) if "**" in a.path else (a.path, {}, None)
    reader = spark.read.options(**files)
    if name == "jsonl":
        out = reader.json(path)
    elif name == "json":
        out = reader.option("multiLine", "true").json(path)
    elif name in ("parquet", "orc", "text"):
        out = reader.format(name).load(path)
    elif name == "csv":
        out = _csv(spark, path, options, files)
    elif name in PARSERS:
        out = _documents(spark, path, name, options, files)
    else:
        raise ValueError(f"unknown format {name!r}")
    if whole:
        out = out.where(F.col("_in_path" if name in PARSERS else "_metadata.file_path").rlike(whole))
    return with_lineage(out, index) if lineage or index else out.drop(*_PLACE) if name in PARSERS else out


def load_profile(spark: SparkSession, profiles: Profiles, name: str, params: dict[str, str] | None = None) -> DataFrame:
    """A saved source: a SQL text, a set of files with a filter, or an HTTP endpoint."""
    own = profiles.load(name)
    if "sql" in own:
        if "tables" in own:
            for table, where in own["tables"].items():
                load(spark, where).createOrReplaceTempView(table)
        return run_sql(spark, own["sql"], params)
    if "pattern" in own:
        out = load(spark, own["pattern"], lineage=own.get("inject_meta", True))
        return apply(out, own["filter"]) if own.get("filter") else out
    headers = {k: v for k, v in own.get("headers", {}).items()}
    if any("\r" in v or "\n" in v for v in headers.values()):
        raise ValueError("a header must be one line")
    query = urllib.parse.urlencode(params or {})
    url = own.get("base_url", "") + own.get("path", "")
    return load(spark, url + (("&" if "?" in url else "?") + query if query else ""), headers=headers)


def inspect_profile(spark: SparkSession, profiles: Profiles, name: str, params: dict[str, str] | None = None) -> DataFrame:
    """field, type and the rest of inspect_schema() for a profile's records, with the profile's name first."""
    return inspect_schema(load_profile(spark, profiles, name, params)).select(F.lit(name).alias("profile"), "*")


def shell(spark: SparkSession, command: list[str]) -> DataFrame:
    """A command's output lines as (line, text); runs on the driver."""
    import subprocess

    done = subprocess.run(command, capture_output=True, text=True, check=True)
    rows = [(k + 1, x) for k, x in enumerate(done.stdout.splitlines())]
    return spark.createDataFrame(rows, "line long, text string")


__all__ = ["inspect_profile", "load", "load_profile", "shell", "sniff", "with_lineage"]
