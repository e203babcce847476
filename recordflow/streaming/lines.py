"""Files that grow, as a stream of lines: a Python data source, registered with register_lines()."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Endings of packed copies, which are not followed.
PACKED = (".gz", ".bz2", ".zst", ".xz")
#: Bytes of a file that a task reads, and bytes read at once.
CHUNK, BLOCK = 32 << 20, 4 << 20


@dataclass
class Range(InputPartition):
    """Lines of a file that begin from byte a up to byte b."""

    key: str
    path: str
    a: int
    b: int
    first: bool


def _key(path: str) -> str:
    at = os.stat(path)
    return f"{at.st_dev}:{at.st_ino}"


def _whole(path: str) -> int:
    """Bytes up to the last newline; only the unfinished line's own bytes are looked at."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end:
            begin = max(0, end - 65536)
            f.seek(begin)
            found = f.read(end - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return 0


class _Lines(DataSourceStreamReader):
    """An offset is how far each file has been read, by file number; the driver looks at sizes and executors read."""

    def __init__(self, options: dict):
        self.pattern = re.sub("^file:(//)?", "", options["path"])
        self.rotated = str(options.get("rotated", "true")).lower() != "false"
        self.latest = options.get("start", "earliest") == "latest"
        self.chunk = int(options.get("chunk", CHUNK))

    def files(self) -> dict[str, list]:
        own = sorted(glob.glob(self.pattern))
        beside = sorted(set(glob.glob(self.pattern + "?*")) - set(own)) if self.rotated else []
        out: dict[str, list] = {}
        for path in own + [p for p in beside if not p.endswith(PACKED)]:
            try:
                if os.path.isfile(path):
                    out.setdefault(_key(path), [path, _whole(path), path in own])
            except FileNotFoundError:
                continue
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        """Files of the pattern from their beginning; what was rotated away before counts as read."""
        return {k: size if self.latest or not own else 0 for k, (_, size, own) in self.files().items()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {k: size for k, (_, size, _) in self.files().items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        paths = {k: path for k, (path, _, _) in self.files().items()}
        out = []
        for key, size in end.items():
            begin = start.get(key, 0)
            begin = 0 if begin > size else begin  # shorter than before: written anew
            out += [Range(key, paths.get(key, ""), a, min(a + self.chunk, size), a == begin) for a in range(begin, size, self.chunk)]
        return out

    def _open(self, part: Range):
        """The file, under the name that it has now."""
        for path in [part.path, *glob.glob(self.pattern), *glob.glob(self.pattern + "?*")]:
            try:
                if path and _key(path) == part.key:
                    return open(path, "rb"), path
            except FileNotFoundError:
                continue
        raise FileNotFoundError(f"no file of {self.pattern} has the number {part.key}; it was removed before it was read")

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        f, path = self._open(part)
        with f:
            at = part.a
            if not part.first:  # the line over the boundary belongs to the range before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < part.b:
                data = f.read(min(BLOCK, part.b - at))
                if not data:
                    break
                if not data.endswith(b"\n"):
                    data += f.readline()
                cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                begins = np.concatenate(([0], cuts[:-1] + 1))
                lines = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in data.split(b"\n")[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array([part.key] * len(lines), pa.string()), pa.array(begins + at, pa.int64()), pa.array(lines, pa.string())], names=["path", "file", "at", "line"])
                at += len(data)

    def commit(self, end: dict) -> None:
        pass


class Lines(DataSource):
    """format("lines"): (path, file, at, line) of files that grow, every finished line once; at is its first byte, file the file's number.

    Option path is a file or pattern that the driver and the executors see.  Options:
    rotated=false leaves out files whose names begin with the path's, which is how a rotated
    file is read to its end (packed ones are always left out); start=latest begins at the files'
    ends; chunk is how many bytes a task reads.  A file that became shorter is read anew.
    """

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "path string, file string, at long, line string"

    def streamReader(self, schema) -> _Lines:  # noqa: N802
        return _Lines(self.options)


def register(spark: SparkSession) -> None:
    """Makes spark.readStream.format("lines") known."""
    spark.dataSource.register(Lines)
