"""A session with the settings the engine expects; everything else is the cluster's."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "recordflow", **conf: str) -> SparkSession:
    """Times are UTC, plans adapt at run time; conf overrides."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (local tests), a folder in the warehouse, which executors share as well."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/recordflow-checkpoints"
