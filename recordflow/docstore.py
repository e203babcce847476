"""A document store: records with a ``_meta`` struct, soft deletes and versions.

A store is a DataFrame; every operation gives a new one.  ``write`` replaces a
table by writing beside it and renaming.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .operators import edit as apply_edits
from .operators import numbered
from .names import free_name
from .plans.compiler import apply

META = "struct<id: bigint, created_at: timestamp, updated_at: timestamp, deleted: boolean, deleted_at: timestamp, version: bigint>"


def _id() -> Column:
    return F.col("_meta.id")


def empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], f"{schema}, _meta {META}")


def visible(store: DataFrame, include_deleted: bool = False, only_deleted: bool = False) -> DataFrame:
    """Records that are not deleted; or all; or only deleted ones."""
    if only_deleted:
        return store.where("_meta.deleted")
    return store if include_deleted else store.where(~F.coalesce(F.col("_meta.deleted"), F.lit(False)))


def insert(store: DataFrame, new: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Adds records; ids follow the largest one by order (default: the first column), deleted records included; a _meta that comes along is dropped.

    Ids have no gaps; ranges of the order are numbered each, so no task sorts all records.
    """
    new = new.drop("_meta")
    top = store.agg(F.max(_id())).first()[0] or 0
    number = free_name("_id", new.columns)
    made = numbered(new, order or new.columns[:1], number, start=top + 1)
    now = F.current_timestamp()
    meta = F.struct(F.col(number).alias("id"), now.alias("created_at"), now.alias("updated_at"), F.lit(False).alias("deleted"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(1).cast("long").alias("version"))
    return store.unionByName(made.withColumn("_meta", meta).drop(number), allowMissingColumns=True)


def get(store: DataFrame, record: int) -> DataFrame:
    return visible(store).where(_id() == record)


def query(store: DataFrame, expression: str) -> DataFrame:
    return apply(visible(store), expression)


def _touch(store: DataFrame, where: Column, **fields: Column) -> DataFrame:
    meta = F.col("_meta")
    changed = meta.withField("updated_at", F.current_timestamp()).withField("version", F.coalesce(_id() * 0 + F.col("_meta.version"), F.lit(0)) + 1)
    for k, v in fields.items():
        changed = changed.withField(k, v)
    return store.withColumn("_meta", F.when(where, changed).otherwise(meta))


def update(store: DataFrame, record: int, *edits: str, unsafe: bool = False) -> DataFrame:
    """Edits one visible record and counts its version; _meta is protected unless unsafe."""
    if not unsafe and any(e.lstrip("-").lstrip(".").startswith("_meta") for e in edits):
        raise ValueError("_meta is protected")
    hit = (_id() == record) & ~F.coalesce(F.col("_meta.deleted"), F.lit(False))
    changed = _touch(apply_edits(store.where(hit), *edits), F.lit(True))
    return store.where(~F.coalesce(hit, F.lit(False))).unionByName(changed, allowMissingColumns=True)


def delete(store: DataFrame, record: int) -> DataFrame:
    """Marks a record as deleted."""
    return _touch(store, (_id() == record) & ~F.col("_meta.deleted"), deleted=F.lit(True), deleted_at=F.current_timestamp())


def undelete(store: DataFrame, record: int) -> DataFrame:
    return _touch(store, (_id() == record) & F.col("_meta.deleted"), deleted=F.lit(False), deleted_at=F.lit(None).cast("timestamp"))


def purge(store: DataFrame) -> DataFrame:
    """Without the deleted records."""
    return visible(store)


def stats(store: DataFrame) -> DataFrame:
    gone = F.coalesce(F.col("_meta.deleted"), F.lit(False))
    return store.agg(F.count("*").alias("total"), F.count_if(~gone).alias("active"), F.count_if(gone).alias("deleted"), F.max(_id()).alias("max_id"))


def check(store: DataFrame) -> DataFrame:
    """problem, id, count: ids that occur twice, missing ids, deletions without a time."""
    twice = store.groupBy(_id().alias("id")).count().where("id is not null and count > 1").select(F.lit("duplicate id").alias("problem"), "id", "count")
    missing = store.where(_id().isNull()).groupBy().count().where("count > 0").select(F.lit("no id").alias("problem"), F.lit(None).cast("long").alias("id"), "count")
    timeless = store.where("_meta.deleted and _meta.deleted_at is null").groupBy(_id().alias("id")).count().select(F.lit("deleted without a time").alias("problem"), "id", "count")
    return twice.union(missing).union(timeless)


def repair(store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store with one record for each id, the others): the earliest created one stays."""
    n = free_name("_n", store.columns)
    ranked = store.withColumn(n, F.row_number().over(Window.partitionBy(_id()).orderBy(F.col("_meta.created_at").asc_nulls_last(), "_meta.version")))
    return ranked.where(f"{n} = 1 or _meta.id is null").drop(n), ranked.where(f"{n} > 1 and _meta.id is not null").drop(n)


def reindex(store: DataFrame) -> DataFrame:
    """Ids from 1 without gaps, in order of the old ones; records without an id come first, in order of creation; versions go up where the id changes."""
    keyed = store.withColumns({(old := free_name("_old", store.columns)): _id(), (at := free_name("_at", store.columns)): F.col("_meta.created_at")})
    made = numbered(keyed, [old, at], new := free_name("_new", keyed.columns))
    changed = ~F.col(old).eqNullSafe(F.col(new))
    meta = F.col("_meta").withField("id", F.col(new)).withField("version", F.coalesce("_meta.version", F.lit(0)) + changed.cast("long"))
    return made.withColumn("_meta", meta).drop(old, at, new)


def export_rows(store: DataFrame) -> DataFrame:
    """id, created_at, updated_at, deleted, version, and the data as JSON text."""
    data = [c for c in store.columns if c != "_meta"]
    return store.select("_meta.id", "_meta.created_at", "_meta.updated_at", "_meta.deleted", "_meta.version", F.to_json(F.struct(*(F.col(f"`{c}`") for c in data))).alias("data"))


def write(store: DataFrame, path: str) -> str:
    """Replaces the table at path: written beside, renamed; the old one stays as path.bak for undo."""
    spark = store.sparkSession
    fresh = f"{path}.{uuid.uuid4().hex}"
    store.write.parquet(fresh)
    hadoop = spark._jvm.org.apache.hadoop.fs
    here, old, new = (hadoop.Path(p) for p in (path, f"{path}.bak", fresh))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(here):
        fs.delete(old, True)
        fs.rename(here, old)
    fs.rename(new, here)
    return path


def undo(spark, path: str) -> DataFrame:
    """The table as it was before the last write."""
    return spark.read.parquet(f"{path}.bak")
