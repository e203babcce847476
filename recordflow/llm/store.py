"""Lineage cuts: tables written to the folder that all executors share."""

from __future__ import annotations

import contextlib
import functools
import threading
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast, lit, pmod, xxhash64

from ..session import shared_dir


#: Whether Spark deletes an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
#: Of each session with writes under way: their number, and the setting before the first of them.
_WRITES: dict[int, tuple[int, str]] = {}


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Executions inside delete their shuffle files.  The setting is the session's: the first write sets it and the last puts the old value back.

    It can't stay on: a DataFrame that is executed a second time would have to make its shuffles again.
    """
    with _LOCK:
        n, before = _WRITES.get(id(spark), (0, ""))
        if n == 0:
            before = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _WRITES[id(spark)] = (n + 1, before)
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITES.pop(id(spark))
            if n == 1:
                spark.conf.set(_CLEANUP, before)
            else:
                _WRITES[id(spark)] = (n - 1, before)


def save(df: DataFrame, path: str, options: dict[str, str] | None = None) -> None:
    """Writes df as a table; the shuffle files of the job are deleted when it is done."""
    with _cleaned(df.sparkSession):
        df.write.options(compression="zstd", **(options or {})).parquet(path)


#: Tables that cut() made and that are not deleted yet: a list for each tidy operator that this thread is in, the innermost last.
_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def cut(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes df to a table of its own in the shared folder and reads it back.

    Later reads need no executor that ran before, so a lost executor costs a
    re-read and not a recomputation.
    """
    path = f"{shared_dir(df.sparkSession)}/recordflow-{name}-{uuid.uuid4().hex}"
    for made in _MADE.get()[-1:]:
        made.append(path)
    save(df, path, options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _read_by(df: DataFrame) -> set[str]:
    """Names of the folders that df reads."""
    return {f.rsplit("/", 2)[1] for f in df.inputFiles()}


def drop(df: DataFrame) -> None:
    """Deletes the tables of cut() that df reads and nothing else reads any more."""
    for folder in {unquote(f.rsplit("/", 1)[0]) for f in df.inputFiles()}:
        name = folder.rsplit("/", 1)[1]
        if name.startswith("recordflow-"):
            _delete(df.sparkSession, folder)
            for made in _MADE.get():
                made[:] = [p for p in made if p.rsplit("/", 1)[1] != name]


def tidy(operator: Callable) -> Callable:
    """An operator whose tables are deleted when it returns, but for those that its results still read.

    Those pass to the operator that called it.  Each call has a list of its own, so threads don't meet.
    """

    @functools.wraps(operator)
    def run(*args, **kwargs):
        own: list[str] = []
        before = _MADE.set((*_MADE.get(), own))
        try:
            out = operator(*args, **kwargs)
        finally:
            _MADE.reset(before)
        results = [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
        kept = set().union(*map(_read_by, results)) if results else set()
        for p in own if results else []:
            if p.rsplit("/", 1)[1] not in kept:
                _delete(results[0].sparkSession, p)
        for outer in _MADE.get()[-1:]:
            outer.extend(p for p in own if not results or p.rsplit("/", 1)[1] in kept)
        return out

    return run


def large(df: DataFrame) -> DataFrame:
    """df marked for a shuffle join, for tables that grow with the input: Spark may size one too low (compressed files, more rows out of a batch than came in) and broadcast it."""
    return df.hint("merge")


#: Rows of two or three numbers that may be broadcast.
SMALL_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df marked for a broadcast if it has at most SMALL_ROWS rows, which is counted; else for a shuffle join."""
    return broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else large(df)


#: Hashes by which samples are taken are below this.
SPAN = 1 << 40


def hash_bound(n: int, total: int) -> int:
    """A hash far beyond the n-th smallest of total rows."""
    return SPAN if total <= 2 * n else int(SPAN * (n + 6 * n**0.5 + 50) / total)


def first_by_hash(df: DataFrame, keys: list[str], n: int, total: int) -> DataFrame:
    """n of df's total rows, those with the smallest hashes of keys.

    Rows whose hash is far beyond the n-th smallest are dropped before the sort, so
    what the tasks send does not grow with their number.
    """
    h = pmod(xxhash64(*keys), lit(SPAN))
    return df.where(h < hash_bound(n, total)).orderBy(h, *keys).limit(n)


#: Numbers of a row in which tasks send arrays of counts.
CHUNK = 1 << 12


def summed(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum of the arrays (size whole numbers) that count makes of each partition; its size does not depend on the rows."""
    whole = max(1, -(-size // CHUNK)) * CHUNK

    def rows(total: np.ndarray, chunks: list[int]) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(chunks) + 1) * CHUNK, pa.int32()), pa.array(total.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), lists], names=["chunk", "counts"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count(batches)
        if total.any():
            total = np.concatenate((total, np.zeros(whole - size, np.int64))).reshape(-1, CHUNK)
            some = np.flatnonzero(total.any(axis=1))
            yield rows(total[some], some.tolist())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            counts = batch.column("counts").flatten().to_numpy().reshape(-1, CHUNK)
            for chunk, values in zip(batch.column("chunk").to_pylist(), counts, strict=True):
                sums[chunk] = sums[chunk] + values if chunk in sums else values
        if sums:
            yield rows(np.stack(list(sums.values())), list(sums))

    schema = "chunk int, counts array<bigint>"
    found = df.mapInArrow(own, schema).repartition("chunk").mapInArrow(add, schema).toArrow()
    total = np.zeros(whole, np.int64)
    for batch in found.to_batches():
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").flatten().to_numpy().reshape(-1, CHUNK), strict=True):
            total[chunk * CHUNK : (chunk + 1) * CHUNK] += counts
    return total[:size]
