"""Columnar word splitting and shingle hashing shared by the text operators.

Everything here works on one Arrow batch at a time and uses no state that grows
with the corpus.  A word is a maximal run of bytes outside space and \\t..\\r.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at once inside a Python worker.
SLICE_BYTES = 2 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _give_back() -> None:
    """Returns the memory that Arrow and the C library hold but don't use."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about SLICE_BYTES of text each (or most); free memory goes back after each.

    Workers are used again by other operators, so what one keeps is not there for the next.
    """
    n = batch.num_rows
    if n == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(size.astype(np.int64))
    start = 0
    while start < n:
        before = int(upto[start - 1]) if start else 0
        end = int(np.searchsorted(upto, before + (most or SLICE_BYTES), side="right"))
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        _give_back()
        start = end


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as large strings in buffers of their own, nulls as empty strings.

    Slices are copied: ascii_lower of this Arrow version returns zero bytes for a
    large string array whose data does not begin its buffer.
    """
    own = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    return own.take(pa.array(np.arange(len(own))))


def split(text: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words of every text in one flat array, and the offsets of each text in it."""
    if lower:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    keep = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(keep).as_py() and len(flat):
        kept = np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False))))
        flat, offsets = flat.filter(keep), kept[offsets]
    return flat, offsets


def encode(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index of each word in a dictionary of the distinct ones, and that dictionary."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, computed once for each distinct word."""
    index, distinct = encode(words)
    one = xxhash.xxh3_64_intdigest
    table = np.fromiter((one(w) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))
    return table[index] if len(index) else np.zeros(0, np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (splitmix64)."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each place, over the flat array."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _MULT
        out += hashes[j : j + n]
    return mix(out)


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-word shingles of each text, with repeats, and their offsets.

    A text of 1 to k-1 words has one shingle, its whole sequence; an empty one none.
    """
    count = np.diff(offsets)
    many = np.maximum(count - k + 1, (count > 0).astype(np.int64))
    out_offsets = np.concatenate(([0], np.cumsum(many)))
    out = np.zeros(int(out_offsets[-1]), np.uint64)
    all_grams = grams(hashes, k)
    place = np.arange(len(out)) - np.repeat(out_offsets[:-1], many) + np.repeat(offsets[:-1], many)
    whole = np.repeat(count >= k, many)
    out[whole] = all_grams[place[whole]]
    for d in np.flatnonzero((count > 0) & (count < k)):
        own = hashes[offsets[d] : offsets[d + 1]]
        out[out_offsets[d]] = mix(grams(own, len(own)), int(len(own)))[0]
    return out, out_offsets


def ragged(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[begin:end] of every pair, one after another, and their offsets."""
    size = end - begin
    upto = np.concatenate(([0], np.cumsum(size)))
    return values[np.arange(int(upto[-1])) - np.repeat(upto[:-1] - begin, size)], upto
