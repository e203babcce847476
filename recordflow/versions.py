"""A document store in versions: a log of snapshots, each a list of files, of which an update replaces only those it touches.

A snapshot is a file of the log with its number as name, written beside and renamed into place; the
rename fails if that number is there already, so of two writers that began from one version one wins and
the other gets a Conflict.  Old files stay, so every version can be read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import docstore
from .operators.ranges import row_hash

#: Rows of a file about.
FILE_ROWS = 100_000


class Conflict(Exception):
    """Another writer has made the next version."""


@dataclass
class Store:
    """The store in a folder that all executors share; a record has a ``_meta`` with its id."""

    spark: SparkSession
    path: str
    file_rows: int = FILE_ROWS

    # the log

    def _hadoop(self):
        fs = self.spark._jvm.org.apache.hadoop.fs
        return fs, fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _snapshot(self, version: int) -> dict:
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/log/{version:020d}.json").collect()))

    def versions(self) -> list[int]:
        """Numbers of all versions, from 1."""
        fs, own = self._hadoop()
        at = fs.Path(f"{self.path}/log")
        names = [f.getPath().getName() for f in own.listStatus(at)] if own.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _commit(self, before: int, files: list[dict], what: str) -> int:
        fs, own = self._hadoop()
        version = before + 1
        fresh, final = fs.Path(f"{self.path}/log/{uuid.uuid4().hex}.new"), fs.Path(f"{self.path}/log/{version:020d}.json")
        out = own.create(fresh, False)
        out.write(json.dumps({"version": version, "what": what, "files": files}).encode())
        out.close()
        kind = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, final, how)
        except Exception as e:
            own.delete(fresh, False)
            if not own.exists(final):
                raise
            raise Conflict(f"version {version} of {self.path} was made by another writer") from e
        return version

    # files

    def _write(self, rows: DataFrame) -> list[dict]:
        """New files in ranges of ids, so that an id stands in one file, and what the log says of them."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        parts = int(max(1, -(-rows.count() // self.file_rows)))
        ids = F.col("_meta.id")
        spread = rows.repartitionByRange(parts, ids, row_hash(rows)) if parts > 1 else rows.coalesce(1)
        spread.write.parquet(folder)
        named = self.spark.read.schema(rows.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("file"))
        return [r.asDict() for r in named.agg(F.count(F.lit(1)).alias("rows"), F.min("_meta.id").alias("low"), F.max("_meta.id").alias("high")).collect()]  # a row for each file

    def _read(self, files: list[dict]) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(*(f["file"] for f in files)) if files else self.spark.createDataFrame([], self._schema)

    @property
    def _schema(self):
        return self.spark.read.parquet(f"{self.path}/data/*").schema

    # operations

    def read(self, version: int | None = None) -> DataFrame:
        """All records of a version, the last one by default."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise ValueError(f"no version {version or ''} in {self.path}")
        return self._read(self._snapshot(version or known[-1])["files"])

    def append(self, rows: DataFrame, at: int | None = None) -> int:
        """Adds records that have their _meta; at: the version that the writer knows (default: the last)."""
        before = (self.versions() or [0])[-1] if at is None else at
        files = self._snapshot(before)["files"] if before else []
        return self._commit(before, files + self._write(rows), "append")

    def insert(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """Adds records and gives them ids after the largest one."""
        before = (self.versions() or [0])[-1]
        old = self.read() if before else docstore.empty(self.spark, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
        top = max((f["high"] or 0 for f in self._snapshot(before)["files"]), default=0) if before else 0
        made = docstore.insert(old.limit(0), rows, order)
        return self.append(made.withColumn("_meta", F.col("_meta").withField("id", F.col("_meta.id") + top)), before)

    def change(self, ids: list[int], edit: Callable[[DataFrame], DataFrame], what: str = "change", at: int | None = None) -> int:
        """Puts edit's records in place of those of the files whose range holds one of the ids; the other files stay.

        edit gets all records of those files and gives all that are to be there.
        """
        before = self.versions()[-1] if at is None else at
        files = self._snapshot(before)["files"]
        hit = [f for f in files if f["low"] is not None and any(f["low"] <= i <= f["high"] for i in ids)]
        if not hit:
            return before
        fresh = self._write(edit(self._read(hit)).select(*self._read(hit).columns))
        return self._commit(before, [f for f in files if f not in hit] + fresh, what)

    def update(self, record: int, *edits: str, at: int | None = None) -> int:
        return self.change([record], lambda rows: docstore.update(rows, record, *edits), "update", at)

    def delete(self, record: int, at: int | None = None) -> int:
        return self.change([record], lambda rows: docstore.delete(rows, record), "delete", at)

    def undelete(self, record: int, at: int | None = None) -> int:
        return self.change([record], lambda rows: docstore.undelete(rows, record), "undelete", at)

    def undo(self) -> int:
        """A new version with the files of the one before the last."""
        before = self.versions()[-1]
        if before < 2:
            raise ValueError("there is no version before the first")
        return self._commit(before, self._snapshot(before - 1)["files"], "undo")

    def history(self) -> list[dict]:
        """version, what, files and rows of each version."""
        found = [self._snapshot(v) for v in self.versions()]
        return [{"version": s["version"], "what": s["what"], "files": len(s["files"]), "rows": sum(f["rows"] for f in s["files"])} for s in found]


def changes(old: DataFrame, new: DataFrame, keys: list[str], buckets: int = 4096) -> DataFrame:
    """keys, change (added, removed or changed) and columns (names of those that differ) between two tables with unique keys.

    Both sides are first summed by bucket of the keys' hash: rows, and the sum of the rows' hashes.  Only rows of buckets that
    differ are joined; where little has changed, little is shuffled.  Columns that one side lacks are left out; null equals null.
    """
    names = [c for c in old.columns if c in new.columns and c not in keys]
    both = [*keys, *names]
    bucket: Column = F.pmod(F.xxhash64(*(f"`{k}`" for k in keys)), F.lit(buckets))

    def summed(df: DataFrame) -> DataFrame:
        h = F.xxhash64(*(f"`{c}`" for c in both)).cast("decimal(38,0)")
        return df.select(bucket.alias("_b"), h.alias("h")).groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("s"))

    a, b = summed(old).alias("a"), summed(new).alias("b")
    differ = a.join(b, "_b", "full").where(~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.s").eqNullSafe(F.col("b.s")))).select("_b")
    left, right = (df.select(F.struct(*(F.col(f"`{k}`") for k in keys)).alias("k"), F.struct(*(F.col(f"`{c}`") for c in names), F.lit(0).alias("_none")).alias("v"), bucket.alias("_b")).join(F.broadcast(differ), "_b", "left_semi") for df in (old, new))  # a number for each bucket
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    joined = l.join(r, F.col("l.k").eqNullSafe(F.col("r.k")), "full")
    other = F.array_compact(F.array(*(F.when(~F.col(f"l.v.`{c}`").eqNullSafe(F.col(f"r.v.`{c}`")), F.lit(c)) for c in names))) if names else F.array().cast("array<string>")
    kind = F.when(F.col("l.v").isNull(), "added").when(F.col("r.v").isNull(), "removed").when(F.size(other) > 0, "changed")
    out = joined.select(F.coalesce("l.k", "r.k").alias("k"), kind.alias("change"), F.when(kind == "changed", other).alias("columns")).where("change is not null")
    return out.select("k.*", "change", "columns")
