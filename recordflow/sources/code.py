"""Facts about Python source files: files, functions, methods, classes and calls; JVM-side roll-ups after that."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "kind string, file string, name string, line long, end long, params array<string>, caller string, callee string"
_NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]


def _dotted(node: ast.expr) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, *([node.id] if isinstance(node, ast.Name) else [])])) or None


def facts(file: str, text: str) -> Iterator[tuple]:
    """(kind, file, name, line, end, params, caller, callee); a file that does not parse gives only its file fact."""
    yield ("file", file, file.rsplit("/", 1)[-1], 1, text.count("\n") + 1, None, None, None)
    try:
        root = ast.parse(text)
    except (SyntaxError, ValueError):
        return

    def walk(node: ast.AST, scope: tuple[str, ...], in_class: bool) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                yield ("class", file, ".".join((*scope, child.name)), child.lineno, child.end_lineno, None, None, None)
                yield from walk(child, (*scope, child.name), True)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                name = ".".join((*scope, child.name))
                a = child.args
                params = [x.arg for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]
                yield ("method" if in_class else "function", file, name, child.lineno, child.end_lineno, params, None, None)
                yield from walk(child, (*scope, child.name), False)
            else:
                if isinstance(child, ast.Call) and (callee := _dotted(child.func)):
                    yield ("call", file, None, child.lineno, child.end_lineno, None, ".".join(scope) or "<module>", callee)
                yield from walk(child, scope, in_class)

    yield from walk(root, (), False)


def load_code(spark: SparkSession, folder: str, pattern: str = "*.py") -> DataFrame:
    """Facts of all source files below a folder, parsed on the executors, a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in facts(path, data.decode("utf-8", "replace"))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def dead(code: DataFrame) -> DataFrame:
    """Functions and methods whose simple name no call names; names with two underscores around are left out."""
    simple = lambda c: F.element_at(F.split(c, r"\."), -1)
    called = code.where("kind = 'call'").select(simple(F.col("callee")).alias("s")).distinct()
    own = code.where("kind in ('function', 'method')").withColumn("s", simple(F.col("name"))).where(~F.col("s").rlike("^__.*__$"))
    return own.join(called, "s", "left_anti").select("file", "name", "line")


def with_coverage(code: DataFrame, facts_of_lines: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    """Functions and methods with the share of their lines that ran, by containment."""
    own = code.where("kind in ('function', 'method')").select("file", "name", "line", "end")
    lines = facts_of_lines.where("kind = 'line'").select(F.col("file").alias("f"), F.col("line").alias("l"), "hits")
    met = own.join(lines, F.col("file").endswith(F.col("f")) & F.col("l").between(F.col("line"), F.col("end")), "left")
    out = met.groupBy("file", "name", "line").agg(F.count("l").alias("lines"), F.count_if(F.col("hits") > 0).alias("hit_lines"))
    out = out.withColumn("share", F.try_divide(F.col("hit_lines").cast("double"), F.col("lines")))
    if least is not None:
        out = out.where(F.col("share") >= least)
    return out.where(F.col("share") <= most) if most is not None else out
