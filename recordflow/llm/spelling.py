"""Groups of spelling variants by a symmetric-delete join.

1. Words are counted over all texts; they get ids by falling count, then by word, so
   the smallest id of some words is the most frequent one's.
2. Every word emits itself and its distinct single deletions as keys: four polynomial
   hashes (124 bits) of the string, all deletions of a batch at once.  What travels
   is numbers only, however long a word is.
3. Words that share a key are joined and verified: if their lengths differ, one is the
   other without one character; if not, they differ in one character exactly if both
   reach the shared string by deleting at the same place.  Deleting any of a run
   of equal characters gives one string, so a deletion holds the run's first and last
   place, and the runs must overlap.  Two near words share exactly one key.
4. A word's form is its most frequent near word, if that is frequent enough.  Counts
   at least double from word to form, so forms end; pointers to roots are doubled until none moves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import numbered
from . import runs as R
from . import words as W
from .store import cut, drop, large, tidy

#: Distinct words that a task holds before it hands on their counts.
HELD = 300_000

_PRIME = np.int64(2**31 - 1)
_BASES = [pow(48271, 1_000_003 * k, 2**31 - 1) for k in (1, 2, 3, 4)]


def _added(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def _edited(flat: pa.Array, offsets: np.ndarray, ids: list, every: int) -> pa.Table:
    """Counts of runs; where `every` divides the CRC of id:run, the run lacks the character at CRC modulo length."""
    index, distinct = W.encode(flat)
    gone = np.zeros(len(flat), bool)
    changed: Counter[str] = Counter()
    if every:
        n = np.diff(offsets)
        known = np.array([i is not None for i in ids], bool)
        before = np.array([R.zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        h = R.joined(np.repeat(before, n), R.crcs(distinct)[index], R.lengths(distinct)[index])
        gone = (h % every == 0) & np.repeat(known, n)
        at = np.flatnonzero(gone)
        for word, x in zip(flat.take(pa.array(at)).to_pylist(), h[at].tolist(), strict=True):
            cut_at = x % len(word)
            changed[word[:cut_at] + word[cut_at + 1 :]] += 1
    counts = np.bincount(index[~gone], minlength=len(distinct)) if len(flat) else np.zeros(0, np.int64)
    words = pa.concat_arrays([distinct, pa.array(list(changed), pa.large_string())])
    return pa.table({"word": words, "n": pa.array(np.concatenate((counts, np.fromiter(changed.values(), np.int64, len(changed)))).astype(np.int64))})


def word_counts(docs: DataFrame, least_chars: int = 5, least_count: int = 3, every: int = 0) -> DataFrame:
    """word and n of letter runs (A-Z in lower case) of at least least_chars code points and least_count occurrences.

    every: runs whose CRC of doc_id:run it divides lose one character first (made-up
    misspellings; rows without a doc_id have none).  Tasks add up their words before they send them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            for part in W.slices(batch):
                flat, offsets, _ = R.runs(W.texts(part), R.LETTER, latin=True)
                found = _edited(flat, offsets, part.column("doc_id").to_pylist(), every)
                found = found.filter(pc.and_(pc.greater_equal(pc.utf8_length(found.column("word")), least_chars), pc.greater(found.column("n"), 0)))
                held.append(found)
                size += len(found)
                if size > HELD:
                    held = [_added(held)]
                    size = len(held[0])
                    if size > HELD // 2:
                        yield from held[0].to_batches(10_000)
                        held, size = [], 0
        if held:
            yield from _added(held).to_batches(10_000)

    found = docs.select("doc_id", "text").mapInArrow(lambda it: (b.set_column(0, "word", b.column(0).cast(pa.string())) for b in run(it)), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate((out, out * pow(base, len(out), int(_PRIME)) % _PRIME))
    return out[:n]


def deletions(words: pa.Array) -> tuple[np.ndarray, ...]:
    """Keys of each word and of its distinct single deletions: the word's place, two halves of the key, first and last deleted position.

    The word itself has -1 as positions.
    """
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    begin = np.concatenate(([0], np.cumsum(size)))
    of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(points)) - begin[of]
    new = (place == 0) | np.concatenate(([True], points[1:] != points[:-1]))[: len(points)]
    at = np.flatnonzero(new)
    last = place[np.concatenate((at[1:], [len(points)])) - 1] if len(at) else at
    whole, halves = np.arange(len(size)), []
    for base in _BASES:
        upto = np.concatenate(([0], np.cumsum(points * _powers(base, int(size.max(initial=1)))[place] % _PRIME)))
        total = (upto[begin[1:]] - upto[begin[:-1]]) % _PRIME
        before, after = (upto[at] - upto[begin[of[at]]]) % _PRIME, (upto[begin[of[at] + 1]] - upto[at + 1]) % _PRIME
        halves.append(np.concatenate((total, (before + after * pow(base, -1, int(_PRIME))) % _PRIME)))
    none = np.full(len(whole), -1)
    return np.concatenate((whole, of[at])), halves[0] << 31 | halves[1], halves[2] << 31 | halves[3], np.concatenate((none, place[at])), np.concatenate((none, last))


def near_words(words: DataFrame) -> DataFrame:
    """Of words (id, word): id, n_near (how many others are exactly one inserted, deleted or replaced character away) and best, the smallest id of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "word", 1 << 18):
                own = W.texts(part, "word")
                of, k1, k2, i, j = deletions(own)
                size = pc.utf8_length(own).to_numpy(zero_copy_only=False)[of]
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), part.column("id").take(pa.array(of)), *(pa.array(x.astype(np.int32)) for x in (size, i, j))], names=["k1", "k2", "id", "size", "i", "j"])

    keys = words.select("id", "word").mapInArrow(run, "k1 bigint, k2 bigint, id bigint, size int, i int, j int")
    a, b = keys.alias("a"), large(keys.alias("b"))  # Spark sizes keys as the words, of which each has several
    shared = (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2")) & (F.col("a.id") != F.col("b.id"))
    near = (F.col("a.size") != F.col("b.size")) | (F.col("a.i") <= F.col("b.j")) & (F.col("b.i") <= F.col("a.j"))
    return a.join(b, shared & near).groupBy(F.col("a.id").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), F.min("b.id").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """Of links (id, root) without cycles: each id with the end of its chain, in as many rounds as the longest chain has binary digits."""
    now = cut(forms.select("id", "root"), "roots")
    while True:
        a, b = now.alias("a"), large(now.alias("b"))
        step = a.join(b, F.col("a.root") == F.col("b.id"), "left").select("a.id", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved"))
        done = cut(step, "roots")
        drop(now)
        if done.where("moved").isEmpty():
            return done.select("id", "root")
        now = done


@tidy
def spelling_groups(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of words (word, n), each word once.

    form is the near word of largest n (ties: smallest in code-point order) if that is at least
    ratio (2 or more) times the word's n, else null; root the last form that forms lead to, the word
    itself without one.  Rows without a word or n are left out; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms must be at least twice as frequent, else they may go round")
    known = counts.where("word is not null and n is not null").select("word", F.col("n").cast("bigint").alias("n"), (-F.col("n")).alias("down"))
    known = cut(known, "counts")  # numbering reads it several times
    words = cut(numbered(known, ["down", "word"], "id").select("id", "word", "n"), "words")
    drop(known)
    near = near_words(words)
    best = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    far = F.col("form_n") >= ratio * F.col("n")
    linked = words.join(large(near), "id", "left").join(large(best), "best", "left")
    linked = cut(linked.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), *(F.when(far, F.col(c)).alias(c) for c in ("best", "form", "form_n"))), "forms")
    ends = roots(linked.where("best is not null").select("id", F.col("best").alias("root"))).withColumnRenamed("root", "end")
    named = words.select(F.col("id").alias("end"), F.col("word").alias("root"))
    return linked.join(large(ends), "id", "left").join(large(named), "end", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@tidy
def spelling_variants(docs: DataFrame, least_chars: int = 5, least_count: int = 3, ratio: int = 2, every: int = 0) -> DataFrame:
    """spelling_groups of the words of docs (doc_id, text); a null text has none, repeated rows count again, other columns are ignored."""
    return spelling_groups(word_counts(docs, least_chars, least_count, every), ratio)
