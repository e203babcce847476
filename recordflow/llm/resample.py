"""Importance resampling towards a target distribution, over hashed word n-grams.

1. A text of more than ``chunk`` bytes is cut at word boundaries into chunks that
   own a run of words and carry the n - 1 words after it, so a feature belongs to the
   chunk that owns its first word and is counted once.  Chunks are dealt over all
   tasks; shorter texts stay where they are read.
2. Features of all documents and of all target texts are counted by bucket.
3. A bucket's gain is a scaled logarithm of how much more frequent it is in the
   target.  A document weighs the floored mean of its features' gains, summed over its chunks.
4. Weights get Gumbel noise from a hash of the document's id, and the documents with the
   highest scores are drawn, which is sampling without replacement by weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import numbered
from . import runs as R
from . import words as W
from .store import cut, tidy

#: Bytes beyond which a text is cut, and words that a chunk owns.
CHUNK, CHUNK_WORDS = 1 << 16, 8192


def features(text: pa.Array, longest: int, buckets: int, owned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature of every text, the text that it is of, and the words that each text owns.

    owned: words of each text at which a feature may begin (-1: all).
    """
    flat, offsets, _ = R.runs(text, R.WORD)
    index, distinct = W.encode(flat)
    size, crc = R.lengths(distinct)[index], R.crcs(distinct)[index]
    n = np.diff(offsets)
    mine = n if owned is None else np.where(owned < 0, n, np.minimum(owned, n))
    of = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(flat)) - offsets[:-1][of] < mine[of]
    left = n[of] - (np.arange(len(flat)) - offsets[:-1][of])  # words from here to the text's end
    blank = np.uint32(R.zlib.crc32(b" "))
    out, texts, now = [], [], crc
    for k in range(1, longest + 1):
        if k > 1:
            now = R.joined(R.joined(now[:-1], blank, np.ones(len(now) - 1, np.int64)), crc[k - 1 :], size[k - 1 :]) if len(now) else now
        here = np.flatnonzero(first[: len(now)] & (left[: len(now)] >= k))
        out.append(now[here].astype(np.int64) % buckets)
        texts.append(of[here])
    return np.concatenate(out), np.concatenate(texts), mine


def _long(column: str, chunk: int) -> Column:
    return F.coalesce(F.octet_length(column) > chunk, F.lit(False))


def chunks(docs: DataFrame, keys: list[str], text: str, longest: int, words: int = CHUNK_WORDS) -> DataFrame:
    """Each text cut at word boundaries: keys, chunk number, owned words, and the text from the first of them to the last that is carried.

    A text without a word is one chunk that owns none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text):
                for i in range(part.num_rows):
                    row = part.slice(i, 1)
                    own = W.texts(row, text)
                    flat, _, at = R.runs(own, R.WORD)
                    data, _ = R.data_of(own)
                    size = R.lengths(flat)
                    begins = np.arange(0, max(1, len(flat)), words)
                    upto = np.minimum(begins + words, len(flat))
                    last = np.minimum(upto + longest - 1, len(flat))
                    cuts = [data[at[a] : at[c - 1] + size[c - 1]].tobytes() if c > a else b"" for a, c in zip(begins, last, strict=True)]
                    same = pa.array(np.zeros(len(cuts), np.int64))
                    columns = [row.column(k).take(same) for k in keys]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(begins // words), pa.array(upto - begins), pa.array(cuts, pa.binary()).cast(pa.string())], names=[*keys, "chunk", "owned", "text"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, text).mapInArrow(run, f"{kinds}, chunk bigint, owned bigint, text string")


def _pieces(docs: DataFrame, longest: int, chunk: int, words: int) -> tuple[DataFrame, DataFrame]:
    """Short texts as they are, and the chunks of long ones, dealt over all tasks; both by doc_id and hash of the text."""
    own = docs.select("doc_id", "text").withColumn("sig", F.xxhash64("text"))
    short = own.where(~_long("text", chunk)).select("doc_id", "sig", F.lit(0).cast("bigint").alias("chunk"), F.lit(-1).cast("bigint").alias("owned"), "text")
    return short, chunks(own.where(_long("text", chunk)), ["doc_id", "sig"], "text", longest, words).repartition("doc_id", "sig", "chunk")


def bucket_counts(docs: DataFrame, longest: int = 2, buckets: int = 10_000, chunk: int = CHUNK, words: int = CHUNK_WORDS) -> np.ndarray:
    """Features of all texts by bucket: a row of each task for a bucket, summed by Spark; the driver gets one for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in W.slices(batch):
                found, _, _ = features(W.texts(part), longest, buckets, part.column("owned").to_numpy(zero_copy_only=False))
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for piece in _pieces(docs, longest, chunk, words):
        found = piece.select("owned", "text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        out[found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: how much more frequent it is in the target, floor(1000 ln ratio) with one added to every count."""
    s, t, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = 2, chunk: int = CHUNK, words: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean of the features' gains, 0 without any) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                found, of, mine = features(W.texts(part), longest, len(gain), part.column("owned").to_numpy(zero_copy_only=False))
                n = np.bincount(of, minlength=part.num_rows)
                total = np.zeros(part.num_rows, np.int64)
                np.add.at(total, of, gain[found])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("sig"), part.column("chunk"), pa.array(mine), pa.array(n), pa.array(total)], names=["doc_id", "sig", "chunk", "n_words", "n_features", "gain"])

    schema = "doc_id bigint, sig bigint, chunk bigint, n_words bigint, n_features bigint, gain bigint"
    short, long = (p.mapInArrow(run, schema) for p in _pieces(docs, longest, chunk, words))
    # rows equal in id and text are summed together: each has its share
    copies = F.count_if(F.col("chunk") == 0)
    shares = [(F.sum(c) / copies).cast("bigint").alias(c) for c in ("n_words", "n_features")] + [F.expr("sum(gain) div count_if(chunk = 0)").alias("gain")]
    long = long.groupBy("doc_id", "sig").agg(*shares, copies.alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    names = ["doc_id", "n_words", "n_features", "gain"]
    mean = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features"))
    return short.select(names).unionByName(long.select(names)).select(*names[:3], mean.cast("bigint").alias("weight"))


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256 of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


@tidy
def resample(docs: DataFrame, target: DataFrame, percent: int = 25, longest: int = 2, buckets: int = 10_000, least_words: int = 20, seed: int = 7, chunk: int = CHUNK, words: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text).

    target has a text column.  Of the N rows with a doc_id and least_words words
    floor(percent * N / 100) are drawn, and ranked from 1 by falling score, ties by
    doc_id, then by n_features and weight; the rank of others is null.  A null text counts as empty:
    no features, weight 0.  A row without a doc_id has no score.  Repeated rows are
    rows of their own; other columns are ignored; an empty table gives no rows, an
    empty target only smoothed counts.
    """
    gain = gains(bucket_counts(docs, longest, buckets, chunk, words), bucket_counts(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), longest, buckets, chunk, words))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = cut(weights(own, gain, longest, chunk, words).withColumn("score", F.col("weight") + noise(seed)), "scores")
    enough = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    able = scored.where(enough)
    drawn = percent * able.count() // 100
    ranked = numbered(able.withColumn("down", -F.col("score")), ["down", "doc_id", "n_features", "weight"], "place")
    names = ["doc_id", "n_features", "weight", "score"]
    done = ranked.select(*names, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    return done.unionByName(scored.where(~enough).select(*names, F.lit(None).cast("bigint").alias("rank")))
