"""Operators with state for each key over endless streams: numbers, first and last records, and profiles.

Each is a state machine for one key (transformWithState); its state is in the checkpoint, so a
query that is started again goes on.  Spark keeps such state in RocksDB: use_state_store() chooses it.
State has a bounded size for each key.  Within one batch the records of a key are put in order; later
batches come after earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def use_state_store(spark: SparkSession) -> None:
    """The state store that keyed state needs, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rows(parts: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    found = pd.concat(list(parts), ignore_index=True)
    return found.sort_values(order, kind="stable", ignore_index=True) if order else found


def _ddl(schema: T.StructType, names: list[str]) -> str:
    return ", ".join(f"`{n}` {schema[n].dataType.simpleString()}" for n in names)


@dataclass
class _Kept(StatefulProcessor):
    """idle: milliseconds after which a key without records is forgotten (None: never)."""

    order: list[str]
    idle: int | None

    def wait(self, timers) -> None:
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)

    def close(self) -> None:
        pass


@dataclass
class _Numbers(_Kept):
    name: str = "seq"
    most: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.count = handle, handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.count.get()[0] if self.count.exists() else 0
        found = _rows(rows, self.order)
        found[self.name] = range(n + 1, n + len(found) + 1)
        self.count.update((n + len(found),))
        self.wait(timerValues)
        yield found if self.most is None else found[found[self.name] <= self.most]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.count.clear()
        yield from ()


@dataclass
class _Ring(_Kept):
    fields: str = ""
    columns: tuple[str, ...] = ()
    most: int = 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.ring = handle, handle.getListState("ring", self.fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = pd.DataFrame(list(self.ring.get()), columns=list(self.columns)) if self.ring.exists() else None
        new = _rows(rows, self.order)[list(self.columns)].tail(self.most)
        now = new if old is None or old.empty else pd.concat([old, new], ignore_index=True).tail(self.most)
        self.ring.put([tuple(None if pd.isna(v) else v for v in r) for r in now.itertuples(index=False, name=None)])
        self.wait(timerValues)
        out = now.reset_index(drop=True)
        out["place"] = range(1, len(out) + 1)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.ring.clear()
        yield from ()


@dataclass
class _Profile(_Kept):
    """Of each field: values, least, greatest and sum so far."""

    keys: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n bigint")
        self.seen = handle.getMapState("seen", "field string", "count bigint, low double, high double, sum double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.count.get()[0] if self.count.exists() else 0
        now = {f: self.seen.getValue((f,)) if self.seen.containsKey((f,)) else (0, None, None, 0.0) for f in self.fields}
        for part in rows:
            n += len(part)
            for f in self.fields:
                values = part[f].dropna()
                if len(values):
                    count, low, high, total = now[f]
                    a, b = float(values.min()), float(values.max())
                    now[f] = (count + len(values), a if low is None else min(low, a), b if high is None else max(high, b), total + float(values.sum()))
        self.count.update((n,))
        for f, v in now.items():
            self.seen.updateValue((f,), v)
        self.wait(timerValues)
        yield pd.DataFrame([(*key, f, n, c, low, high, total, total / c if c else None) for f, (c, low, high, total) in now.items()], columns=[*self.keys, "field", "records", "count", "min", "max", "sum", "mean"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.count.clear()
        self.seen.clear()
        yield from ()


def _run(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str, idle: int | None) -> DataFrame:
    return stream.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="none" if idle is None else "processingTime")


def keyed_numbers(stream: DataFrame, keys: list[str], order: list[str], name: str = "seq", idle: int | None = None) -> DataFrame:
    """Records with a number from 1 for each key, without gaps, in the order of batches and, within one, of order.

    idle: milliseconds after which a key without records begins again.
    """
    fields = [f for f in stream.schema.names if f != name]
    return _run(stream.select(*fields), keys, _Numbers(order, idle, name), f"{_ddl(stream.schema, fields)}, `{name}` bigint", "append", idle)


def keyed_head(stream: DataFrame, keys: list[str], n: int, order: list[str], name: str = "seq", idle: int | None = None) -> DataFrame:
    """The first n records of each key, numbered; later ones are counted and not kept."""
    fields = [f for f in stream.schema.names if f != name]
    return _run(stream.select(*fields), keys, _Numbers(order, idle, name, n), f"{_ddl(stream.schema, fields)}, `{name}` bigint", "append", idle)


def keyed_tail(stream: DataFrame, keys: list[str], n: int, order: list[str], idle: int | None = None) -> DataFrame:
    """The last n records of each key, in place 1 to n; keys with new records come whole again in update mode."""
    fields = [f for f in stream.schema.names if f != "place"]
    shape = _ddl(stream.schema, fields)
    return _run(stream.select(*fields), keys, _Ring(order, idle, shape, tuple(fields), n), f"{shape}, place bigint", "update", idle)


def keyed_profile(stream: DataFrame, keys: list[str], fields: list[str], idle: int | None = None) -> DataFrame:
    """analyze for each key so far: a row of each number field with records, count, min, max, sum and mean; in update mode."""
    schema = f"{_ddl(stream.schema, keys)}, field string, records bigint, count bigint, min double, max double, sum double, mean double"
    return _run(stream.select(*dict.fromkeys([*keys, *fields])), keys, _Profile([], idle, tuple(keys), tuple(fields)), schema, "update", idle)
