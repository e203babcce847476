"""A persistent index: a table in blocks that are sorted by a hash of their key, and a manifest of the blocks.

The manifest has of each block its file, its rows, the least and greatest hash, and a Bloom filter of the keys.
Blocks are ranges of (hash, key, hash of the row), so they are of about equal size even if one key has most of
the rows.  A lookup reads the blocks whose range holds a wanted hash and whose filter does not rule it out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import free_name
from .operators import join as plain_join
from .operators.joins import range_join
from .operators.ranges import row_hash

#: Rows of a block at most, and bits of its filter for each row.
BLOCK_ROWS, BITS = 100_000, 10
PROBES = 4


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bits for each hash."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) % np.uint64(bits) for k in range(PROBES)], axis=1).astype(np.int64)


def _filter(hashes: np.ndarray) -> bytes:
    bits = 8 * max(8, -(-len(hashes) * BITS // 8))
    mask = np.zeros(bits, bool)
    mask[_places(hashes, bits).ravel()] = True
    return np.packbits(mask, bitorder="little").tobytes()


def _may_hold(bloom: bytes, hashes: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(bloom, np.uint8)
    at = _places(hashes, 8 * len(bits))
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def build(df: DataFrame, key: str, path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Writes df as an index by key in a new folder; rows without a key are left out."""
    spark = df.sparkSession
    h = free_name("_hash", df.columns)
    rows = df.where(F.col(f"`{key}`").isNotNull()).withColumn(h, F.xxhash64(f"`{key}`"))
    parts = int(max(1, -(-rows.count() // block_rows)))
    spread = rows.repartitionByRange(parts, F.col(h), F.col(f"`{key}`"), row_hash(df)) if parts > 1 else rows.coalesce(1)
    spread.sortWithinPartitions(h, f"`{key}`").write.option("maxRecordsPerFile", block_rows).parquet(f"{path}/blocks")

    def block(rows: pa.Table) -> pa.Table:
        """One block's row of the manifest; a block has block_rows rows at most."""
        own = np.unique(rows.column("h").to_numpy())
        return pa.table({"file": rows.column("file").slice(0, 1), "rows": [rows.num_rows], "low": [own[0]], "high": [own[-1]], "bloom": pa.array([_filter(own)], pa.binary())})

    found = spark.read.parquet(f"{path}/blocks").select(F.col("_metadata.file_path").alias("file"), F.col(h).alias("h"))
    found.groupBy("file").applyInArrow(block, "file string, rows bigint, low bigint, high bigint, bloom binary").write.option("key", key).parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    whole = spark.read.parquet(f"{path}/blocks")
    found = spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)
    return found.drop(whole.columns[-1])


def blocks_for(spark: SparkSession, path: str, key: str, keys: list) -> list[str]:
    """Files of the blocks that may hold one of some keys; the manifest is read once, and its filters are tested where they are read."""
    kind = spark.read.parquet(f"{path}/blocks").schema[key].dataType
    hashes = np.array(sorted(r.h for r in spark.createDataFrame([(k,) for k in keys], "k " + ("string" if kind.simpleString() == "string" else kind.simpleString())).select(F.xxhash64("k").alias("h")).collect()), np.int64)

    def test(batches):
        for batch in batches:
            files = []
            for file, low, high, bloom in zip(*(batch.column(c).to_pylist() for c in ("file", "low", "high", "bloom")), strict=True):
                near = hashes[np.searchsorted(hashes, low) : np.searchsorted(hashes, high, side="right")]
                if len(near) and _may_hold(bloom, near).any():
                    files.append(file)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])

    return [r.file for r in manifest(spark, path).select("file", "low", "high", "bloom").mapInArrow(test, "file string").collect()]


def lookup(spark: SparkSession, path: str, key: str, keys: list) -> DataFrame:
    """Rows whose key is one of some values, from the blocks that may hold them."""
    return _read(spark, path, blocks_for(spark, path, key, keys)).where(F.col(f"`{key}`").isin(list(keys)))


def indexed_join(left: DataFrame, path: str, left_key: str, key: str, how: str = "left", **options) -> DataFrame:
    """operators.join of left with the indexed table; blocks in whose range no key of left falls are not read."""
    spark = left.sparkSession
    wanted = left.select(F.xxhash64(F.col(f"`{left_key}`").cast(spark.read.parquet(f"{path}/blocks").schema[key].dataType)).alias("h")).distinct()
    needed = range_join(wanted, manifest(spark, path).select("file", "low", "high"), [], "h", "low", "high").select("file").distinct()
    return plain_join(left, _read(spark, path, [r.file for r in needed.collect()]), left_key=left_key, right_key=key, how=how, **options)  # a name for each block
