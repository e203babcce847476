"""Words as runs of allowed bytes, and CRC-32 of joined byte strings, for whole batches at once."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

#: Byte to byte, A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are separated by any character below U+0080 that is neither digit nor letter (after LOWER).
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

#: Letters a-z; with LATIN_LEAD and the byte after it, U+00C0 to U+00FF too.
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LATIN_LEAD = 0xC3


def data_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large string array that owns its buffers, and its offsets in them."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1] if len(text) else np.zeros(1, np.int64)
    held = text.buffers()[2]
    return np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8), offsets


def runs(text: pa.Array, allowed: np.ndarray, latin: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Maximal runs of allowed bytes in each text, A-Z lower-cased.

    They come in one flat array, with the offsets of each text in it and the place
    of each run's first byte among the texts' bytes.  latin: U+00C0 to U+00FF are allowed, too.
    """
    data, offsets = data_of(text)
    data = LOWER[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    mask = allowed[data]
    if latin:
        lead = data == LATIN_LEAD
        mask = mask | lead
        mask[1:] |= lead[:-1]
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    start[firsts] = mask[firsts]
    at = np.flatnonzero(start)
    upto = np.cumsum(mask)
    ends = np.concatenate((upto[at] - 1, [upto[-1] if len(upto) else 0])).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[mask]))])
    return flat, np.searchsorted(at, offsets), at


def lengths(words: pa.Array) -> np.ndarray:
    """Bytes of each word."""
    return np.diff(np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]) if len(words) else np.zeros(0, np.int64)


def crcs(words: pa.Array) -> np.ndarray:
    """CRC-32 of each word's UTF-8 bytes."""
    return np.fromiter(map(zlib.crc32, words.cast(pa.large_binary()).to_pylist()), np.uint32, len(words))


#: Bytes by which a CRC is moved in one step, at most.
LONGEST = 128


def _moves() -> np.ndarray:
    """For 0 to LONGEST zero bytes and each byte of a CRC: what the byte's bits become behind so many zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    table = np.zeros((LONGEST + 1, 4, 256), np.uint32)
    for j in range(4):
        table[0, j] = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
    for n in range(LONGEST):
        table[n + 1] = (table[n] >> 8) ^ one[table[n] & 255]
    return table


MOVES = _moves()


def _moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = MOVES[n, 0, crc & 255]
    for j in (1, 2, 3):
        out ^= MOVES[n, j, (crc >> np.uint32(8 * j)) & 255]
    return out


def joined(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 of a string followed by another, from their CRCs and the second one's n bytes."""
    first, n = np.asarray(first, np.uint32), np.asarray(n, np.int64)
    far = np.flatnonzero(n > LONGEST)
    if len(far):
        first, left = first.copy(), n[far]
        while len(far):
            first[far] = _moved(first[far], np.full(len(far), LONGEST))
            left = left - LONGEST
            far, left = far[left > LONGEST], left[left > LONGEST]
        n = np.where(n > LONGEST, (n - 1) % LONGEST + 1, n)
    return _moved(first, n) ^ second
