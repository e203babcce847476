"""Pattern packing of documents into sequences by non-negative least squares.

The histogram of piece lengths has at most ``capacity`` entries however large the
corpus is, so the plan is made on the driver from that histogram alone:

1. Patterns of one to three lengths that fill a sequence exactly are enumerated.
2. Repeat counts x >= 0 that minimise |A x - h|^2 are fitted (A: how often a
   pattern uses a length, h: the histogram) and rounded down.
3. What is left is packed by best fit on the remaining histogram: the longest
   piece, then the pieces that fill its gap exactly or leave least, as often as
   all of them last.  Each step uses up a length, so steps don't grow with rows.

Pieces are then numbered within their length, and the plan maps (length, number)
to a sequence and an offset.  No piece is dropped and no count is capped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe as B
from . import words as W
from .store import cut, tidy

#: Lengths that triples may take their two smaller parts from: the most frequent ones.
TRIPLE_LENGTHS = 128
#: Steps of the projected gradient.
FIT_STEPS = 400


def patterns_of(histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Patterns of up to three present lengths that sum to the capacity, the last index of histogram."""
    capacity = len(histogram) - 1
    there = np.flatnonzero(histogram)
    have = set(there.tolist())
    out: list[tuple[int, ...]] = [(capacity,)] if capacity in have else []
    out += [(capacity - b, b) for b in there.tolist() if 2 * b <= capacity and capacity - b in have]
    often = there[np.argsort(-histogram[there], kind="stable")][:TRIPLE_LENGTHS]
    often = np.sort(often[often < capacity]).tolist()
    for k, c in enumerate(often):
        out += [(a, b, c) for b in often[k:] if (a := capacity - b - c) >= b and a in have]
    return out


def fit(patterns: list[tuple[int, ...]], histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients on the sparse pattern matrix."""
    which = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    length = np.array([v for p in patterns for v in p], np.int64)
    h = histogram / max(1.0, histogram.max())
    use = np.bincount(length, minlength=len(h))
    step = 1.0 / (3.0 * use.max())  # the largest eigenvalue is at most (longest pattern) x (most used length)
    x = np.zeros(len(patterns))
    y, speed = x.copy(), 1.0
    for _ in range(FIT_STEPS):
        residual = np.bincount(length, weights=y[which], minlength=len(h)) - h
        new = np.maximum(0.0, y - step * np.bincount(which, weights=residual[length], minlength=len(x)))
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        y, x, speed = new + (speed - 1) / faster * (new - x), new, faster
    return x * max(1.0, histogram.max())


def _gap(left: np.ndarray, gap: int) -> list[int]:
    """Lengths still there that fill a gap: one or two that fit it exactly, else the longest that fits."""
    if gap <= 0:
        return []
    if left[gap]:
        return [gap]
    small = left[: gap + 1] > 0
    small[0] = False
    pair = np.flatnonzero(small & small[::-1])
    for b in pair[::-1].tolist():
        if 2 * b != gap or left[b] >= 2:
            return [b, gap - b]
    top = np.flatnonzero(small)
    return [int(top[-1])] if len(top) else []


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many sequences like it), using the histogram up exactly."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        need = np.bincount(lengths, minlength=len(left))
        used = np.flatnonzero(need)
        times = min(times, int((left[used] // need[used]).min()))
        if times > 0:
            left[used] -= times * need[used]
            out.append((lengths, times))

    found = patterns_of(left)
    if found:
        x = fit(found, left)
        for k in np.argsort(-x, kind="stable").tolist():
            if x[k] >= 1:
                take(found[k], int(x[k]))
    while left.any():
        lengths = [int(np.flatnonzero(left)[-1])]
        rest = left.copy()
        rest[lengths[0]] -= 1
        gap = len(left) - 1 - lengths[0]
        while more := _gap(rest, gap):
            for v in more:
                rest[v] -= 1
                gap -= v
            lengths += more
        take(tuple(lengths), int(left.sum()))
    return out


def piece_table(docs: DataFrame, path: str, capacity: int, separator: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = B.load(path)
        for batch in batches:
            for part in W.slices(batch, most=B.SLICE):
                ids, at = B.encode_batch(bpe, W.texts(part))
                many = np.diff(at) + 1
                own = np.full(len(ids) + len(many), separator, "<u4")
                upto = np.concatenate(([0], np.cumsum(many)))
                own[np.arange(len(ids)) + np.repeat(np.arange(len(many)), many - 1)] = ids
                pieces = -(-many // capacity)
                doc = np.repeat(np.arange(len(many)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, many[doc] - start)
                raw, first = memoryview(own.tobytes()), (upto[doc] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def numbered(pieces: DataFrame) -> DataFrame:
    """Adds number, from 0 within each length, without gathering a length in one task.

    A length's pieces are dealt over buckets; the number is the place in the bucket
    plus the pieces of the buckets before.
    """
    total = pieces.count()
    buckets = max(256, -(-total // 1_000_000))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").count()
    before = counts.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return dealt.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("number", F.col("before") + F.col("own") - 1).drop("bucket", "before", "own")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length of 1 to capacity."""
    spark = pieces.sparkSession
    histogram = np.zeros(capacity + 1, np.int64)
    for length, count in pieces.groupBy("length").count().collect():  # at most capacity rows
        histogram[length] = count
    used, segments, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for lengths, times in plan(histogram):
        offset = 0
        for v in lengths:
            segments.append((v, int(used[v]), sequence, offset))
            used[v] += times
            offset += v
        sequence += times
    segments.sort()
    table = np.array(segments, np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast(table)  # its size depends on the capacity, not on the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_rows = shared.value
        key = (plan_rows[:, 0] << 48) + plan_rows[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(key, (length << 48) + number, side="right") - 1
            sequence_id = plan_rows[at, 2] + number - plan_rows[at, 1]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence_id), pa.array(plan_rows[at, 3])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return numbered(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(run, schema)


@tidy
def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    A document is its token ids (vocabulary file ``path``) and one separator; only
    one longer than the capacity is cut.  A null text counts as empty and is one
    separator.  Repeated rows are packed each; an empty table gives no rows; other
    columns are ignored.
    """
    return pack(cut(piece_table(docs, path, capacity, separator), "pieces"), capacity)
