"""A format of its own, as a Python data source with pushed filters and committed writes, and a table function.

A table is a folder of gzipped NDJSON files and a manifest that says of each file its rows and, of each plain
column, its least and greatest value.  Readers plan from the manifest: a pushed filter leaves
out the files that cannot hold a row, and is applied to the rows of the others.  Writers put files
beside the table; only the commit of all tasks renames them into it and replaces the manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.json as pajson
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema

_MANIFEST = "manifest.json"
#: Rows of a file at most; a task writes as many files as it needs.
FILE_ROWS = 100_000

_TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path names, as executors and the driver see it."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _manifest(path: str) -> dict | None:
    fs, root = _at(path)
    if fs.get_file_info(f"{root}/{_MANIFEST}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{root}/{_MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class _File(InputPartition):
    name: str


def _plain(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType | T.StringType | T.BooleanType | T.DoubleType)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.pushed = path, schema, []

    def _may_hold(self, file: dict) -> bool:
        for f in self.pushed:
            low, high = file["range"].get(f.attribute[0]) or (None, None)
            if low is None:  # only nulls, which no comparison takes
                return False
            if isinstance(f, In) and not any(v is not None and low <= v <= high for v in f.value):
                return False
            if isinstance(f, EqualTo) and not low <= f.value <= high or isinstance(f, GreaterThan) and not high > f.value or isinstance(f, GreaterThanOrEqual) and not high >= f.value or isinstance(f, LessThan) and not low < f.value or isinstance(f, LessThanOrEqual) and not low <= f.value:
                return False
        return True

    def partitions(self) -> list[_File]:
        return [_File(f["name"]) for f in (_manifest(self.path) or {"files": []})["files"] if self._may_hold(f)]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        if part is None or not getattr(part, "name", None):
            return
        fs, root = _at(self.path)
        kinds = to_arrow_schema(self.schema)
        with fs.open_input_stream(f"{root}/{part.name}", compression="gzip") as f:
            found = pajson.read_json(f, parse_options=pajson.ParseOptions(explicit_schema=kinds, unexpected_field_behavior="ignore"))
        for f in self.pushed:
            column = found.column(f.attribute[0])
            keep = pc.is_valid(column) if isinstance(f, IsNotNull) else pc.is_in(column, pa.array(f.value, column.type)) if isinstance(f, In) else _TESTS[type(f)](column, pa.scalar(f.value, column.type))
            found = found.filter(keep)
        yield from found.select(kinds.names).cast(kinds).to_batches()


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes comparisons of plain columns with values; the others stay Spark's."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if type(f) in (*_TESTS, In, IsNotNull) and name in self.schema.names and _plain(self.schema[name].dataType):
                self.pushed.append(f)
            else:
                yield f


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite, self.job = path, schema, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """One task: files in the job's own folder; an error takes back what it wrote."""
        fs, root = _at(self.path)
        fs.create_dir(f"{root}/_writing-{self.job}", recursive=True)
        done: list[dict] = []
        try:
            held: list[pa.RecordBatch] = []
            for batch in iterator:
                held.append(batch)
                if sum(b.num_rows for b in held) >= FILE_ROWS:
                    done.append(self._file(fs, root, pa.Table.from_batches(held)))
                    held = []
            if held:
                done.append(self._file(fs, root, pa.Table.from_batches(held)))
        except BaseException:
            self._drop(fs, root, done)
            raise
        return _Written(done)

    def _file(self, fs: pafs.FileSystem, root: str, rows: pa.Table) -> dict:
        name = f"part-{uuid.uuid4().hex}.jsonl.gz"
        with fs.open_output_stream(f"{root}/_writing-{self.job}/{name}", compression="gzip") as f:
            for r in rows.to_pylist():
                f.write((json.dumps({k: v for k, v in r.items() if v is not None}, ensure_ascii=False, default=str) + "\n").encode())
        span = {c: [x.as_py() for x in pc.min_max(rows.column(c)).values()] for c in self.schema.names if _plain(self.schema[c].dataType)}
        return {"name": name, "rows": rows.num_rows, "range": span}

    def _drop(self, fs: pafs.FileSystem, root: str, files: list[dict]) -> None:
        for x in files:
            if fs.get_file_info(f"{root}/_writing-{self.job}/{x['name']}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{root}/_writing-{self.job}/{x['name']}")

    def commit(self, messages: list[_Written | None]) -> None:
        """Files move into the table; they count once the manifest that names them takes the old one's place."""
        fs, root = _at(self.path)
        before = _manifest(self.path) or {"files": []}
        files = [x for m in messages if m is not None for x in m.files]
        for x in files:
            fs.move(f"{root}/_writing-{self.job}/{x['name']}", f"{root}/{x['name']}")
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{_MANIFEST}.{self.job}") as f:
            f.write(json.dumps({"schema": self.schema.jsonValue(), "files": files if self.overwrite else before["files"] + files}).encode())
        fs.move(f"{root}/{_MANIFEST}.{self.job}", f"{root}/{_MANIFEST}")
        for x in before["files"] if self.overwrite else []:
            fs.delete_file(f"{root}/{x['name']}")
        self._clear(fs, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_at(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/_writing-{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_writing-{self.job}")


class Records(DataSource):
    """format("records"): tables of NDJSON files with a manifest, in a folder that all executors share.

    With option push=true comparisons of numbers, texts and booleans with values go down to the reader and
    leave the plan.  Spark keeps what a query pushed with the loaded DataFrame, and a later query on the same one
    that pushes nothing would miss rows; so with push, load the table anew for every query.
    mode("append") adds files, mode("overwrite") replaces the table; a failed task or job leaves neither rows nor files.
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> T.StructType:
        found = _manifest(self.options["path"])
        if found is None:
            raise FileNotFoundError(f"no table of records in {self.options['path']}")
        return T.StructType.fromJson(found["schema"])

    def reader(self, schema: T.StructType) -> _Reader:
        kind = _PushingReader if str(self.options.get("push", "false")).lower() == "true" else _Reader
        return kind(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)


@udtf(returnType="id bigint, at timestamp, session int, place int")
class Sessions:
    """Table function sessions(TABLE(...) PARTITION BY user ORDER BY (at), seconds): rows of (id, at) with the number of their session.

    A session ends where the next row is more than so many seconds later; the state is one time, however long a partition is.
    """

    def __init__(self):
        self.last, self.session, self.place = None, 0, 0

    def eval(self, row, seconds: int):
        at = row["at"]
        if self.last is None or at is None or (at - self.last).total_seconds() > seconds:
            self.session, self.place = self.session + 1, 0
        self.place += 1
        self.last = at if at is not None else self.last
        yield row["id"], at, self.session, self.place


def register(spark: SparkSession) -> None:
    """Makes format("records") and the table function sessions() known, and lets filters go down to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Records)
    spark.udtf.register("sessions", Sessions)
