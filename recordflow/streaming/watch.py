"""A folder's changes as a stream: a Python data source, registered with register()."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class _Changes(SimpleDataSourceStreamReader):
    """The offset is the folder's state when it was last looked at: size and time of each file."""

    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")
        self.include = options.get("include", "*").split(",")
        self.exclude = [p for p in options.get("exclude", "").split(",") if p]
        self.first = str(options.get("initial", "true")).lower() != "false"

    def state(self) -> dict[str, list[int]]:
        out = {}
        for base, _, names in os.walk(self.folder):
            for n in names:
                path = os.path.join(base, n)
                inner = os.path.relpath(path, self.folder)
                if any(fnmatch.fnmatch(inner, p) for p in self.include) and not any(fnmatch.fnmatch(inner, p) for p in self.exclude):
                    try:
                        at = os.stat(path)
                    except FileNotFoundError:
                        continue
                    out[inner] = [at.st_size, at.st_mtime_ns]
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {} if self.first else self.state()}

    @staticmethod
    def _between(old: dict, new: dict) -> Iterator[tuple]:
        gone = [(p, "deleted", None) for p in old if p not in new]
        return iter(sorted(gone + [(p, "modified" if p in old else "created", v[0]) for p, v in new.items() if old.get(p) != v]))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self.state()
        return self._between(start["files"], now), {"files": now}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return self._between(start["files"], end["files"])

    def commit(self, end: dict) -> None:
        pass


class Watch(DataSource):
    """format("watch"): (path, event, size) of files below a folder that the driver sees.

    event is created, modified or deleted.  Options: include and exclude (patterns,
    comma-joined), initial=false leaves out the files that are there at the start.
    """

    @classmethod
    def name(cls) -> str:
        return "watch"

    def schema(self) -> str:
        return "path string, event string, size long"

    def simpleStreamReader(self, schema) -> _Changes:  # noqa: N802
        return _Changes(self.options)


def register(spark: SparkSession) -> None:
    """Makes spark.readStream.format("watch") known."""
    spark.dataSource.register(Watch)
