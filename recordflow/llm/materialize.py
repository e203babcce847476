"""Training-order materialisation of token ids in fixed-stride shards.

Every document's ids are cut into sequences of one length, padded to one stride.
Rows are dealt into hash buckets of document id and text and sorted there, so the
sequences are numbered from 0 without gaps as they are made: by bucket, document id,
text and piece, and not by where a row stands.  The same documents and key give the
same order.  A keyed Feistel network on the next even number of bits, walked along
its cycle until it falls below the count, permutes the numbers: the global slot in
training order.  Shards are ranges of slots, so place and resumption are arithmetic:
slot s stands in shard s // shard_rows at byte (s % shard_rows) * stride.  Each range
partition writes its shards as binary files of shard_rows * stride bytes (the last
one ends with the last slot), which are read by seek.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe as B
from . import words as W
from .store import cut, drop, save, shared_dir, tidy

ROUNDS = 6
#: Documents of a bucket, about; sequences are numbered bucket by bucket.
BUCKET_ROWS = 20_000
#: Bytes of shards in a file between the sort and the writing of shards, about; tasks of a shuffle at most (then they take more).
FILE_BYTES, TASKS = 32 << 20, 50_000


def permute(number: np.ndarray, count: int, key: int) -> np.ndarray:
    """The slot of each number below count: a permutation of range(count) for each key."""
    half = max(1, (max(1, count - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = number.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (W.mix(right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1)), r + 1) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= count]
    return out.astype(np.int64)


def sequences(docs: DataFrame, path: str, length: int, separator: int, pad: int) -> DataFrame:
    """bucket, number (in the bucket), doc_id, piece, n_tokens, ids_crc32, payload (length ids as unsigned 16 bits, padded).

    Rows that are equal in doc_id and text are alike in all of this but their numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = B.load(path)
        if max(bpe.text) > 0xFFFF:
            raise ValueError("ids need more than 16 bits")
        now, following = -1, 0
        for batch in batches:
            for part in W.slices(batch, most=B.SLICE):
                ids, at = B.encode_batch(bpe, W.texts(part))
                many = np.diff(at) + 1
                pieces = -(-many // length)
                first = np.concatenate(([0], np.cumsum(pieces)))
                flat = np.full(int(first[-1]) * length, pad, "<u2")
                doc = np.repeat(np.arange(len(many)), many - 1)
                flat[first[doc] * length + np.arange(len(ids)) - at[doc]] = ids
                flat[first[:-1] * length + many - 1] = separator
                owner = np.repeat(np.arange(len(many)), pieces)
                piece = np.arange(len(owner)) - first[owner]
                n = np.minimum(length, many[owner] - piece * length)
                raw = memoryview(flat.tobytes())
                body = [raw[2 * length * k : 2 * length * (k + 1)] for k in range(len(owner))]
                crc = [zlib.crc32(b[: 2 * m]) for b, m in zip(body, n.tolist(), strict=True)]
                bucket = part.column("bucket").to_numpy()[owner]
                starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                number = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
                if bucket[0] == now:
                    number[bucket == now] += following
                now, following = bucket[-1], int(number[-1]) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array(number), part.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array([bytes(b) for b in body], pa.binary())],
                    names=["bucket", "number", "doc_id", "piece", "n_tokens", "ids_crc32", "payload"],
                )

    buckets = max(64, -(-docs.count() // BUCKET_ROWS))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest"))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)))
    dealt = keyed.repartitionById(min(buckets, TASKS), (F.col("bucket") % TASKS).cast("int")).sortWithinPartitions("bucket", "doc_id", "digest").select("bucket", "doc_id", "text")
    return dealt.mapInArrow(run, "bucket bigint, number bigint, doc_id bigint, piece bigint, n_tokens bigint, ids_crc32 bigint, payload binary")


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri if ":" in uri else os.path.abspath(uri))


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """rows, dealt out by shard and sorted by slot, with file: where each stands; the binary files are written as rows pass.

    A shard's file gets its name when it is complete, so a task that runs again replaces it by the same bytes.
    """
    rows = rows.drop("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(folder)
        store.create_dir(base, recursive=True)
        now, out, name, temp = None, None, "", ""

        def close() -> None:
            if out is not None:
                out.close()
                store.move(f"{base}/{temp}", f"{base}/{name}")

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, offset, payload = batch.column("shard").to_numpy(), batch.column("byte_offset").to_numpy(), batch.column("payload")
            ends = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            files = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if shard[a] != now:
                    close()
                    now, name, temp = shard[a], f"shard-{shard[a]:08d}-{len(payload[a].as_py())}.bin", f".{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{base}/{temp}")
                if out.tell() != offset[a]:
                    raise ValueError(f"slots of shard {now} are not in order or not complete")
                out.write(b"".join(payload[a:b].to_pylist()))
                files += [f"{folder}/{name}"] * (b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, pa.string())], names=[*batch.schema.names, "file"])
        close()

    return rows.mapInArrow(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", file string")


def read_files(index: DataFrame) -> DataFrame:
    """The rows of write_files without their payload, in slot order -> with it, read by seek."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, source = None, None
        for batch in batches:
            file, offset = batch.column("file").to_pylist(), batch.column("byte_offset").to_numpy()
            found, a = [], 0
            while a < len(file):
                stride, b = stride_of(file[a]), a + 1
                while b < len(file) and file[b] == file[a] and offset[b] == offset[b - 1] + stride:
                    b += 1
                if file[a] != now:
                    store, path = _place(file[a])
                    now, source = file[a], store.open_input_file(path)
                raw = source.read_at((b - a) * stride, int(offset[a]))
                if len(raw) != (b - a) * stride:
                    raise ValueError(f"{now} ends early")
                found += [raw[k : k + stride] for k in range(0, len(raw), stride)]
                a = b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "payload"])

    return index.mapInArrow(run, index.schema.simpleString()[7:-1].replace(":", " ") + ", payload binary")


def stride_of(file: str) -> int:
    """Bytes of a sequence in a shard's file, from its name."""
    return int(file.rsplit("-", 1)[1].removesuffix(".bin"))


def read_slots(file: str, from_byte: int = 0) -> Iterator[np.ndarray]:
    """Token ids of a shard's sequences in training order, resumed at a byte offset; no Spark."""
    store, path = _place(file)
    with store.open_input_file(path) as source:
        source.seek(from_byte)
        while raw := source.read(stride_of(file)):
            yield np.frombuffer(raw, "<u2")


@tidy
def materialize(docs: DataFrame, path: str, length: int = 512, shard_rows: int = 8192, key: int = 1, separator: int = 0, pad: int = 0, folder: str | None = None) -> DataFrame:
    """slot, shard, byte_offset, doc_id, piece, n_tokens, ids_crc32, file, payload of every sequence, each shard in slot order.

    The shards are written to folder (by default, one of its own in the shared
    folder), with a table of their rows in its folder index; file is the one with the
    slot, and payload is read back from it.  A null text counts as empty: one sequence
    with the separator.  Repeated rows have slots of their own; rows without a doc_id
    are ordered by text; other columns are ignored; an empty table gives no rows.
    """
    pieces = cut(sequences(docs, path, length, separator, pad), "sequences")
    ends = pieces.groupBy("bucket").agg((F.max("number") + 1).alias("n")).toArrow()  # two numbers for BUCKET_ROWS documents
    bucket = ends.column("bucket").to_numpy()
    size = np.zeros(bucket.max(initial=0) + 1, np.int64)
    size[bucket] = ends.column("n").to_numpy()
    before, count = np.cumsum(size) - size, int(size.sum())

    @F.pandas_udf("long")
    def slot(bucket: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(permute(before[bucket.to_numpy()] + number.to_numpy(), count, key))

    rows = pieces.withColumn("slot", slot("bucket", "number")).select(
        "slot",
        F.floor(F.col("slot") / shard_rows).cast("long").alias("shard"),
        (F.col("slot") % shard_rows * (2 * length)).alias("byte_offset"),
        "doc_id",
        "piece",
        "n_tokens",
        "ids_crc32",
        "payload",
    )
    stride = 2 * length
    group = max(1, FILE_BYTES // (shard_rows * stride)) * shard_rows  # slots of a file: whole shards
    own = group * max(1, -(-count // (group * TASKS)))
    deal = lambda df: df.repartitionById(max(1, -(-count // own)), F.floor(F.col("slot") / own).cast("int")).sortWithinPartitions("slot")
    # A file is one row group and so one task's input: whole shards in order.  The table stands between shuffle and
    # shards, so that at no time both stages' data and the pieces are kept.
    ordered = cut(deal(rows), "slots", {"maxRecordsPerFile": str(group), "parquet.block.size": str(4 * group * stride)})
    drop(pieces)
    folder = folder or f"{shared_dir(docs.sparkSession)}/recordflow-shards-{uuid.uuid4().hex}"
    written = write_files(ordered, folder)
    save(written.drop("payload"), f"{folder}/index")
    drop(ordered)
    return read_files(deal(docs.sparkSession.read.schema(written.drop("payload").schema).parquet(f"{folder}/index")))


def read_shard(spark: SparkSession, folder: str, shard: int, from_byte: int = 0) -> DataFrame:
    """A shard's rows in training order, resumed at a byte offset; the table gives the places, the binary file the ids."""
    index = spark.read.parquet(f"{folder}/index").where((F.col("shard") == shard) & (F.col("byte_offset") >= from_byte))
    return read_files(index.orderBy("slot"))
