"""Structured Streaming forms: followed folders, stateless expressions, windows, sessions and joins of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..names import free_name


def follow(spark: SparkSession, folder: str, schema, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """Records of a folder's files, present and coming ones, each file once; apply() works on the result."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", str(files_per_trigger)) if files_per_trigger else reader).load(folder)


def _timed(stream: DataFrame, time: str, late: str) -> tuple[DataFrame, str]:
    """The stream with its time as a timestamp column that has the watermark, and that column's name."""
    name = free_name("_time", stream.columns)
    return stream.withColumn(name, F.col(f"`{time}`").cast("timestamp")).withWatermark(name, late), name


def _counted(stream: DataFrame, time: str, late: str, keys: list[str], window) -> DataFrame:
    timed, name = _timed(stream, time, late)
    w = free_name("_window", timed.columns)
    out = timed.groupBy(window(name).alias(w), *(F.col(f"`{k}`") for k in keys)).agg(F.count(F.lit(1)).alias("count"))
    return out.select(F.col(f"{w}.start").alias("start"), F.col(f"{w}.end").alias("end"), *(F.col(f"`{k}`") for k in keys), "count")


def tumbling_counts(stream: DataFrame, time: str, width: str, keys: list[str], late: str) -> DataFrame:
    """start, keys and count by window; a window is final, and its state dropped, once the watermark passes its end."""
    return _counted(stream, time, late, keys, lambda t: F.window(t, width)).drop("end")


def sliding_counts(stream: DataFrame, time: str, width: str, slide: str, keys: list[str], late: str) -> DataFrame:
    """start, end, keys and count by windows of a width that begin every slide; a record counts in each window over it."""
    return _counted(stream, time, late, keys, lambda t: F.window(t, width, slide))


def session_counts(stream: DataFrame, time: str, gap: str, keys: list[str], late: str) -> DataFrame:
    """start, end, keys and count by session: records of the keys with less than a gap between them; end is the last one's time and the gap."""
    return _counted(stream, time, late, keys, lambda t: F.session_window(t, gap))


def join_streams(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_time: str, right_time: str, before: str, after: str, late: str, how: str = "inner") -> DataFrame:
    """Records of two streams with equal keys, right's time from left's less `before` to left's plus `after`.

    Both have watermarks, so what can find no partner any more is dropped; with how="left" it
    comes alone then.  Columns of right that left has are named with _right.
    """
    taken = [c.lower() for c in left.columns]
    right = right.toDF(*(c + "_right" if c.lower() in taken else c for c in right.columns))
    renamed = lambda c: c + "_right" if c.lower() in taken else c
    (l, lt), (r, rt) = _timed(left, left_time, late), _timed(right, renamed(right_time), late)  # noqa: E741
    if lt == rt:
        r, rt = r.withColumnRenamed(rt, rt + "_right"), rt + "_right"
    on = F.expr(f"`{rt}` >= `{lt}` - interval {before} and `{rt}` <= `{lt}` + interval {after}")
    for a, b in keys:
        on = on & (F.col(f"`{a}`") == F.col(f"`{renamed(b)}`"))
    return l.join(r, on, "left_outer" if how == "left" else how).drop(lt, rt)


def running_counts(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by keys over all that came so far; state grows with the number of keys."""
    return stream.groupBy(*keys).count()


def with_table(stream: DataFrame, table: DataFrame, on: str, how: str = "left") -> DataFrame:
    """A stream joined to a static table."""
    return stream.join(table, on, how)


def run_available(stream: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs all that is available now into a table in a folder, goes on from where it ended before, and reads the table.

    Each batch is a part of the table that is written as a whole, so one that is run again
    replaces itself.  append: all parts.  update: of each of keys the rows of its last part.  complete: the last part.
    """

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch{number}")

    spark = stream.sparkSession
    started = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    started.start().awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{folder}/rows/batch*")
    if mode == "append":
        return found
    batch, last = free_name("_batch", found.columns), free_name("_last", found.columns)
    found = found.withColumn(batch, F.regexp_extract("_metadata.file_path", r"/batch(\d+)/", 1).cast("long"))
    if mode == "complete":
        newest = found.agg(F.max(batch).alias(batch))  # one row
        return found.join(F.broadcast(newest), batch, "left_semi").drop(batch)
    own = Window.partitionBy(*(F.col(f"`{k}`") for k in keys or []))
    return found.withColumn(last, F.max(batch).over(own)).where(F.col(batch) == F.col(last)).drop(batch, last)
