"""BPE encoding by a prefix-sharing trie, and decoding.

The distinct words of a batch, sorted, are the depth-first order of their trie.
Every prefix carries one state, the last token of its encoding: the encoding of
a prefix is the encoding of what stands before its last token, plus that token.
A token t may follow s exactly if the merges turn the text of s and t into those
two tokens again.  A prefix that words share is one node with one state; states
pass from a node to all that stand below it, and sibling branches advance
together in numpy arrays.  A word's ids are read back along the last tokens.

Texts of ASCII and plain Latin-1 letters are split by the vocabulary's pattern in
Arrow; others by the library's own normaliser and pre-tokeniser.  All merges are
decided here.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words as W

#: Longest word, in bytes, that goes into the array trie; longer ones are walked alone.
LONGEST_WORD = 40
#: Bytes of text whose distinct words are encoded at once.
SLICE = 4 << 20

#: Classes of a plain text's bytes: white space, letter (bytes from 0x80 on stand in letters of two bytes), digit,
#: other visible; ODD sends the text to the library's normaliser and classes.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
_CLASS = np.full(256, ODD, np.uint8)
_CLASS[0x21:0x7F] = OTHER
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = LETTER
_CLASS[0x30:0x3A] = DIGIT
#: Fixed values of the vocabulary's split pattern: endings that are pieces of their own.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


_BASE = 0x9E3779B97F4A7C15


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBPE:
    """Encoder for a byte-level BPE vocabulary file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.parts = {m: p for p, (_, m) in reversed(self.rank.items())}
        self.order = {m: r for r, m in reversed(self.rank.values())}
        self.single: dict[int, bool] = {}
        self.letters = byte_letters()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.back = {c: b for b, c in enumerate(byte_letters())}
        self._tables()

    def _merge(self, ids: list[int]) -> list[int]:
        """The merges applied lowest rank first, leftmost first, as the model defines them."""
        rank = self.rank
        while len(ids) > 1:
            best = min(((rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank), default=None)
            if best is None:
                break
            k = best[1]
            ids = ids[:k] + [rank[ids[k], ids[k + 1]][1]] + ids[k + 2 :]
        return ids

    def symbols(self, token: str) -> list[int]:
        """A token's text as single-symbol ids."""
        body = token.removesuffix(self.end)
        out = [*body]
        if token.endswith(self.end) and body:
            out[-1] += self.end
        return [self.vocab[c] for c in out]

    def follows(self, s: int, t: int) -> bool:
        """Whether the merges leave s t as these two tokens.

        Undoes the merges of both from the latest on; s t fails if, at some moment
        on the way, the two tokens that touch would have merged earlier than what
        is undone there.
        """
        found = self.compatible.get((s, t))
        if found is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            a, b, limit, found = s, t, len(self.rank), None
            while found is None:
                merge = self.rank.get((a, b))
                left, right = self.order.get(a, -1), self.order.get(b, -1)
                if merge is not None and merge[0] < limit:
                    found = False
                elif left < 0 and right < 0:
                    found = True
                elif left > right:
                    a, limit = self.parts[a][1], left
                else:
                    b, limit = self.parts[b][0], right + 1
            self.compatible[s, t] = found
        return found

    def whole(self, t: int) -> bool:
        """Whether a token's own text is encoded as that token."""
        found = self.single.get(t)
        if found is None:
            found = self.single[t] = self._merge(self.symbols(self.text[t])) == [t]
        return found

    def _tables(self) -> None:
        """Arrays by which suffixes are looked up: hashes of token texts, with and without word end."""
        back = self.back
        self.size = np.zeros(max(self.text) + 1, np.int64)
        found: dict[int, int] = {}
        for t, i in self.vocab.items():
            done = t.endswith(self.end) and t != self.end
            body = bytes(back[c] for c in (t.removesuffix(self.end) if done else t))
            self.size[i] = len(body)
            found[self._hash(body, done)] = i
        self.hashes = np.array(sorted(found), np.uint64)
        self.ids = np.array([found[int(h)] for h in self.hashes], np.int32)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        self.powers = np.array([pow(_BASE, k, 1 << 64) for k in range(LONGEST_WORD + 1)], np.uint64)
        self.widest = int(self.size.max())

    @staticmethod
    def _hash(body: bytes, done: bool) -> int:
        h = 0
        for b in body:
            h = (h * _BASE + b + 1) & (2**64 - 1)
        return int(W.mix(np.array([h], np.uint64), int(done))[0])

    def _look(self, h: np.ndarray, done: bool) -> np.ndarray:
        """Token ids of suffix hashes, -1 where no token has that text."""
        h = W.mix(h, int(done))
        out = np.full(len(h), -1, np.int32)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[place] == h[at]
        out[at[hit]] = self.ids[place[hit]]
        return out

    def _allowed(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """follows() of every pair, decided once for each distinct one; s = -1: nothing stands before t."""
        pairs, at = np.unique((s.astype(np.int64) << 32) | t, return_inverse=True)
        ok = [self.whole(p & 0xFFFFFFFF) if p < 0 else self.follows(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()]
        return np.array(ok, bool)[at]

    def _states(self, state: np.ndarray, prefix: np.ndarray, row: np.ndarray, n: np.ndarray, done: bool) -> np.ndarray:
        """The last token of the first n symbols of the given rows, longest candidate first."""
        out = np.full(len(row), -1, np.int32)
        left = np.arange(len(row))
        for size in range(min(self.widest, int(n.max(initial=0))), 0, -1):
            some = left[n[left] >= size]
            r, k = row[some], n[some]
            t = self._look(prefix[r, k] - prefix[r, k - size] * self.powers[size], done)
            some, t = some[t >= 0], t[t >= 0]
            if len(some):
                ok = self._allowed(state[row[some], n[some] - size], t)
                out[some[ok]] = t[ok]
                left = left[out[left] < 0]
        if len(left):
            raise ValueError("a symbol without a token")
        return out

    def _alone(self, body: bytes) -> list[int]:
        """Ids of one long word, along its own chain of prefixes."""
        text = "".join(self.letters[b] for b in body)
        states, n = [-1], len(text)
        for k in range(1, n + 1):
            tail = self.end if k == n else ""
            for size in range(min(k, self.widest), 0, -1):
                t = self.vocab.get(text[k - size : k] + tail)
                if t is not None and (self.whole(t) if size == k else self.follows(states[k - size], t)):
                    states.append(t)
                    break
        out = []
        while n > 0:
            out.append(states[n])
            n -= int(self.size[states[n]])
        return out[::-1]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (already split and lower-case) in one array, and each word's offsets in it."""
        words = words.cast(pa.large_binary())
        order = pc.sort_indices(words).to_numpy()
        ordered = words.take(pa.array(order))
        at = np.asarray(ordered.buffers()[1]).view(np.int64)[ordered.offset : ordered.offset + len(ordered) + 1]
        data = np.frombuffer(ordered.buffers()[2] or b"", np.uint8)
        length = np.diff(at)
        lists: dict[int, list[int]] = {}
        for i in np.flatnonzero(length > LONGEST_WORD):
            lists[int(i)] = self._alone(data[at[i] : at[i + 1]].tobytes())
        special = {pc.index(ordered, pa.scalar(t.encode(), pa.large_binary())).as_py(): i for t, i in self.special.items()}
        lists |= {k: [i] for k, i in special.items() if k >= 0}
        rows = np.setdiff1d(np.arange(len(ordered)), np.array(list(lists), np.int64))
        length, start = length[rows], at[rows]
        n = len(rows)
        width = int(length.max(initial=0))
        column = np.arange(width)
        inside = column[None, :] < length[:, None]
        matrix = np.where(inside, data[np.minimum(start[:, None] + column[None, :], max(len(data) - 1, 0))] if n else 0, 0)
        prefix = np.zeros((n, width + 1), np.uint64)
        for k in range(width):
            prefix[:, k + 1] = prefix[:, k] * np.uint64(_BASE) + (matrix[:, k].astype(np.uint64) + np.uint64(1))
        same = (matrix[1:] == matrix[:-1]) & inside[1:] & inside[:-1]
        shared = np.concatenate(([0], np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64))) if n else np.zeros(0, np.int64)
        shared[1:] = np.minimum(shared[1:], length[:-1] - 1)
        state = np.full((n, width + 1), -1, np.int32)
        for k in range(1, width):
            new = (shared < k) & (length > k)
            row = np.flatnonzero(new)
            if not len(row):
                continue
            state[row, k] = self._states(state, prefix, row, np.full(len(row), k), False)
            state[:, k] = state[np.maximum.accumulate(np.where(new, np.arange(n), 0)), k]
        last = self._states(state, prefix, np.arange(n), length, True)
        back, place, alive = [last], length - self.size[last], np.arange(n)
        ranks = [alive]
        place = place.copy()
        while len(alive := alive[place[alive] > 0]):
            t = state[alive, place[alive]]
            place[alive] -= self.size[t]
            back.append(t)
            ranks.append(alive)
        count = np.zeros(len(ordered), np.int64)
        for r in ranks:
            count[rows[r]] += 1
        for k, ids in lists.items():
            count[k] = len(ids)
        upto = np.concatenate(([0], np.cumsum(count)))
        flat = np.zeros(int(upto[-1]), np.uint32)
        for step, (r, t) in enumerate(zip(ranks, back, strict=True)):
            flat[upto[rows[r] + 1] - 1 - step] = t
        for k, ids in lists.items():
            flat[upto[k] : upto[k + 1]] = ids
        # back to the order in which the words came
        of = np.empty(len(order), np.int64)
        of[order] = np.arange(len(order))
        return ragged(flat, upto, of)

    def split(self, text: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, lower-case, in one array, and each text's offsets in it."""
        at = np.asarray(text.buffers()[1]).view(np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        kind = _CLASS[raw]
        after = np.append(raw[1:], 0).astype(np.uint8)
        odd_at = (kind == ODD) | ((raw == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((raw == 0x3C) & (after == 0x7C))
        odd = np.add.reduceat(np.append(odd_at, False), at[:-1], dtype=np.int64) * (np.diff(at) > 0) > 0 if len(text) else np.zeros(0, bool)
        if odd.any():
            kind[np.repeat(odd, np.diff(at))] = SPACE  # these texts' pieces are found below
        pieces, offsets = _plain_pieces(raw, kind, at)
        if not odd.any():
            return pieces, offsets
        slow = {i: self._pieces(text[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        flat = pa.concat_arrays([pieces, pa.array([p for i in slow for p in slow[i]], pa.large_string())])
        many = np.diff(offsets)
        begin = offsets[:-1].copy()
        at_slow = len(pieces)
        for i, own in slow.items():
            begin[i], many[i] = at_slow, len(own)
            at_slow += len(own)
        upto = np.concatenate(([0], np.cumsum(many)))
        return flat.take(pa.array(np.arange(int(upto[-1])) - np.repeat(upto[:-1] - begin, many))), upto

    def _pieces(self, text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            found = [(p, s) for s in self.special if (p := text.find(s, at)) >= 0]
            upto, token = min(found, default=(len(text), ""))
            plain = self.library.normalizer.normalize_str(text[at:upto])
            out += [bytes(self.back[c] for c in p).decode("utf-8") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
            out += [token] if token else []
            at = upto + len(token)
        return out

    def decode(self, ids) -> str:
        """Text of ids as the library joins them when the file names no decoder: token texts, one space between."""
        return " ".join(self.text[int(i)] for i in ids)


_LOADED: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    """The encoder for a vocabulary file, once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def _plain_pieces(raw: np.ndarray, kind: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces of plain texts by byte class: runs of letters, single digits, runs of others, and the endings."""
    n = len(raw)
    before = np.concatenate((np.zeros(1, np.uint8), kind))[:-1] if n else kind
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    before[first[:n]] = SPACE
    small = np.where((raw >= 0x41) & (raw <= 0x5A), raw + 0x20, raw).astype(np.uint8)
    second = np.concatenate((np.zeros(1, bool), raw[:-1] == 0xC3)) if n else np.zeros(0, bool)
    small[second & (raw >= 0x80) & (raw <= 0x9E)] += 0x20
    start = (kind != before) | (kind == DIGIT)
    for q in np.flatnonzero((raw == 0x27) & (before != OTHER) & (kind == OTHER)).tolist():
        end = int(at[np.searchsorted(at, q, side="right")])
        tail = small[q + 1 : min(q + 3, end)].tobytes().decode("latin-1")
        for e in _ENDINGS:
            if tail.startswith(e):
                start[q + 1] = False
                if q + 1 + len(e) < end and kind[q + 1 + len(e)] == LETTER:
                    start[q + 1 + len(e)] = True
                break
    solid = kind != SPACE
    start &= solid
    begin = np.flatnonzero(start)
    upto = np.concatenate(([0], np.cumsum(solid)))
    edges = np.append(upto[begin], upto[-1]).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(edges), pa.py_buffer(small[solid]))
    return pieces, np.searchsorted(begin, at)


def ragged(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that index names, one after another, and their offsets."""
    size = np.diff(offsets)[index]
    upto = np.concatenate(([0], np.cumsum(size)))
    return flat[np.arange(int(upto[-1])) - np.repeat(upto[:-1] - offsets[:-1][index], size)], upto


def encode_batch(bpe: WordBPE, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of texts in one array, and each text's offsets in it."""
    pieces, offsets = bpe.split(text)
    index, distinct = W.encode(pieces)
    table, at = bpe.encode_words(distinct)
    ids, upto = ragged(table, at, np.asarray(index, np.int64))
    return ids, upto[offsets]


def decode_batch(bpe: WordBPE, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Decoded text of each run of ids."""
    top = max(bpe.text) + 1
    shown = pa.array([bpe.text.get(i, "") for i in range(top)], pa.large_string())
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), shown.take(pa.array(ids.astype(np.int64))))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (with keep_ids also ids and decoded) of each row.

    A null text counts as empty: no ids, empty decoded text.  Repeated rows are
    each encoded; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in W.slices(batch, most=SLICE):
                ids, at = encode_batch(bpe, W.texts(part))
                decoded = decode_batch(bpe, ids, at)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                plain = [hashlib.sha256(t).hexdigest() for t in decoded.cast(pa.large_binary()).to_pylist()]
                out = [part.column("doc_id"), pa.array(np.diff(at)), pa.array(sums), pa.array(plain)]
                if keep_ids:
                    out += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64))), decoded.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * keep_ids
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)
