"""Tables of the session's catalog as a source: a container lists its tables, a table or a query gives records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def container(spark: SparkSession, database: str | None = None) -> DataFrame:
    """table, kind, columns (their number) of every table and view of a database, by name; only the catalog is asked."""
    rows = []
    for t in sorted(spark.catalog.listTables(database), key=lambda t: t.name):
        where = t.name if t.isTemporary else ".".join(f"`{p}`" for p in [*(t.namespace or []), t.name])
        rows.append((t.name, "view" if t.tableType in ("VIEW", "TEMPORARY") else "table", len(spark.table(where).columns)))
    return spark.createDataFrame(rows, "table string, kind string, columns long")


def table(spark: SparkSession, name: str, limit: int | None = None) -> DataFrame:
    """Records of a table; a limit is pushed to the scan."""
    out = spark.table(name)
    return out if limit is None else out.limit(limit)
