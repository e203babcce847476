"""Command line: python -m recordflow COMMAND ADDRESS ... [--out ADDRESS]."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import analyze, edit, head, inspect_schema, join, merge, tail
from .plans import apply, slurp
from .profiles import Profiles
from .session import session
from .sinks import save, table_text
from .sources import load


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recordflow")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options) -> argparse.ArgumentParser:
        c = sub.add_parser(name, **options)
        for a in args:
            c.add_argument(a)
        c.add_argument("--out", help="write to an address instead of printing records")
        c.add_argument("--profiles", action="append", default=[], help="root folder of profiles")
        c.add_argument("--meta", action="store_true", help="add the columns of each record's file")
        return c

    add("cat", "address", help="records of an address")
    c = add("filter", "address", "expression", help="records through an expression")
    c.add_argument("-s", "--slurp", action="store_true", help="the whole stream is one array")
    c.add_argument("--order", action="append", help="column of the stream's order")
    c.add_argument("-r", "--raw", action="store_true", help="print text values without quotes")
    c.add_argument("-e", "--exit-status", action="store_true", help="exit with 1 if nothing came, or the last value is false or null")
    for name in ("head", "tail"):
        c = add(name, "address", help=f"{name} of a stream")
        c.add_argument("-n", "--lines", type=int, default=10)
        c.add_argument("--order", action="append", required=name == "tail")
    c = add("join", "left", "right", help="left join, or inner")
    c.add_argument("--on")
    c.add_argument("--left-key")
    c.add_argument("--right-key")
    c.add_argument("--inner", action="store_true")
    c.add_argument("--strict", action="store_true", help="a record without a key is an error")
    c = add("merge", help="all records of several addresses (path or path:label=NAME)")
    c.add_argument("sources", nargs="+")
    c.add_argument("--no-source", action="store_true")
    c = add("analyze", "address", help="counts and statistics of each field")
    c.add_argument("--sample", type=int)
    c = add("inspect", "address", help="type of each field")
    c.add_argument("--sample", type=int, default=100)
    c = add("edit", "address", help="set, delete, append")
    c.add_argument("edits", nargs="*")
    c.add_argument("--merge")
    c.add_argument("--delete", action="append", default=[], metavar="PATH")
    c = add("table", "address", help="a text table")
    c.add_argument("--style", default="grid")
    return p


def run(a: argparse.Namespace, spark) -> DataFrame:
    read = lambda x: load(spark, x, lineage=a.meta, profiles=Profiles(*a.profiles) if a.profiles else None)
    if a.command in ("cat", "table"):
        return read(a.address)
    if a.command == "filter":
        return slurp(read(a.address), a.expression, a.order) if a.slurp else apply(read(a.address), a.expression)
    if a.command == "head":
        return head(read(a.address), a.lines, a.order)
    if a.command == "tail":
        return tail(read(a.address), a.lines, a.order)
    if a.command == "join":
        a.sides = {"left": (left := read(a.left), a.left_key or a.on), "right": (right := read(a.right), a.right_key or a.on)}
        return join(left, right, a.on, a.left_key, a.right_key, "inner" if a.inner else "left", strict=a.strict)
    if a.command == "merge":
        parts = [s.partition(":label=") for s in a.sources]
        return merge([(p, read(p), *([label] if label else [])) for p, _, label in parts], lineage=not a.no_source)
    if a.command == "analyze":
        return analyze(read(a.address), a.sample)
    if a.command == "inspect":
        return inspect_schema(read(a.address), a.sample)
    return edit(read(a.address), *a.edits, *(f"-{d}" for d in a.delete), merge=a.merge)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    out = run(a, session())
    if a.out:
        save(out, a.out)
    elif a.command == "table":
        print(table_text(out, a.style))
    else:
        last = None
        plain = getattr(a, "raw", False) and out.columns == ["value"]
        for line in _lines(out):
            last = line
            value = json.loads(line)
            print(value["value"] if plain and isinstance(value.get("value"), str) else line)
        if getattr(a, "exit_status", False) and (last is None or out.columns == ["value"] and json.loads(last).get("value") in (None, False)):
            return 1
    for side, (df, key) in getattr(a, "sides", {}).items():
        if missing := df.where(F.col(f"`{key}`").isNull()).count():
            print(f"{missing} records of the {side} side lack the key", file=sys.stderr)
    return 0


def _lines(out: DataFrame) -> Iterator[str]:
    """Records as JSON text, a partition at a time."""
    return (r[0] for r in out.select(F.to_json(F.struct("*"))).toLocalIterator())


if __name__ == "__main__":
    sys.exit(main())
