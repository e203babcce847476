"""Language spans: scripts narrow the candidates, Viterbi labels the words.

A model holds log probabilities of character n-grams (hashed to a fixed number
of classes) for each language, and each language's share of letters by script;
it is learned from a bounded, hash-ordered sample of labelled rows.  A word is a run without blanks,
or one character of a script that is written without them.  A word's candidates are
the languages that use its script, and only those are scored: by the weighted log
likelihood of the word's n-grams.  Viterbi finds the labels of all words of a text
with a penalty for each switch; equal neighbours are a span.  The longest language,
in letters, names the text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .store import SPAN, hash_bound

#: Labelled rows of each language that are learned from at most.
PER_LANGUAGE = 1500
#: Classes of n-grams, their lengths, and the weight of their sum (they overlap, so less than one).
CLASSES, ORDERS, WEIGHT = 1 << 16, (1, 2, 3, 4), 0.4
#: Log cost of a change of language between two words.
PENALTY = 6.0
#: Least share of a language's letters that makes a script one of its scripts.
SCRIPT_SHARE = 0.01
#: How far languages that don't use a word's script stand below those that do.
BARRED = 20.0

#: First code points of ranges and their scripts; a range ends where the next begins.
SCRIPTS = {
    0x0000: "latin", 0x0370: "greek", 0x0400: "cyrillic", 0x0530: "armenian", 0x0590: "hebrew", 0x0600: "arabic", 0x0700: "other", 0x0750: "arabic", 0x0780: "other",
    0x08A0: "arabic", 0x0900: "devanagari", 0x0980: "bengali", 0x0A00: "gurmukhi", 0x0A80: "gujarati", 0x0B00: "oriya", 0x0B80: "tamil", 0x0C00: "telugu", 0x0C80: "kannada",
    0x0D00: "malayalam", 0x0D80: "sinhala", 0x0E00: "thai", 0x0E80: "lao", 0x0F00: "tibetan", 0x1000: "myanmar", 0x10A0: "georgian", 0x1100: "hangul", 0x1200: "ethiopic",
    0x1400: "other", 0x1780: "khmer", 0x1800: "mongolian", 0x18B0: "other", 0x1E00: "latin", 0x1F00: "greek", 0x2000: "other", 0x2C60: "latin", 0x2C80: "other", 0x3040: "kana",
    0x3100: "other", 0x3130: "hangul", 0x3190: "other", 0x31F0: "kana", 0x3200: "other", 0x3400: "han", 0x4DC0: "other", 0x4E00: "han", 0xA000: "other", 0xA640: "cyrillic",
    0xA6A0: "other", 0xA720: "latin", 0xA800: "other", 0xAC00: "hangul", 0xD7B0: "other", 0xF900: "han", 0xFB00: "latin", 0xFB13: "armenian", 0xFB1D: "hebrew", 0xFB50: "arabic",
    0xFE00: "other", 0xFE70: "arabic", 0xFF00: "latin", 0xFF66: "kana", 0xFFA0: "hangul", 0xFFE0: "other", 0x20000: "han", 0x323B0: "other",
}
#: Scripts that are written without blanks between words.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])"
_FIRST = np.array(sorted(SCRIPTS))
NAMES = sorted(set(SCRIPTS.values()))
_SCRIPT = np.array([NAMES.index(SCRIPTS[f]) for f in _FIRST.tolist()])


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of every text in one flat array, and the offsets of each text in it."""
    text = pc.utf8_lower(text)
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    if (raw >= 0xE0).any():  # first byte of the characters from U+0800 on
        text = pc.replace_substring_regex(text, UNSPACED, r" \1 ")
    return W.split(text)


@dataclass
class Coded:
    """Distinct words as code points: per word its n-gram classes, letters and script (-1: no letter)."""

    grams: np.ndarray
    starts: np.ndarray
    letters: np.ndarray
    script: np.ndarray


def coded(words: pa.Array) -> Coded:
    plain = words.to_pylist()
    text = "".join(f"\1{w}\2" for w in plain)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    word = np.repeat(np.arange(len(plain)), size)
    letter = _letters()[raw]
    letters = np.bincount(word[letter], minlength=len(plain))
    script = np.full(len(plain), -1)
    at = np.flatnonzero(letter)[::-1]
    script[word[at]] = _SCRIPT[np.searchsorted(_FIRST, raw[at], side="right") - 1]  # the first letter's is written last
    grams, owner = [], []
    h = np.zeros(len(raw), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(raw) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + raw[n - 1 :].astype(np.uint64) + np.uint64(n)
        if n in ORDERS:
            inside = word[: len(h)] == word[n - 1 :]
            grams.append((W.mix(h[inside], n) >> np.uint64(48)).astype(np.int64))
            owner.append(word[: len(h)][inside])
    owner = np.concatenate(owner) if owner else word
    order = np.argsort(owner, kind="stable")
    return Coded(np.concatenate(grams)[order] if grams else owner, np.searchsorted(owner[order], np.arange(len(plain) + 1)), letters, script)


@dataclass
class Model:
    languages: list[str]
    #: Log probability of each class, classes x languages.
    table: np.ndarray
    #: Which languages use a script, scripts x languages.
    uses: np.ndarray

    def scores(self, c: Coded) -> np.ndarray:
        """Words x languages; words without a letter score 0 for all, languages without the script far below the others."""
        out = np.zeros((len(c.letters), len(self.languages)))
        for script in np.unique(c.script[c.letters > 0]).tolist():
            own = np.flatnonzero((c.script == script) & (c.letters > 0))
            candidates = np.flatnonzero(self.uses[script]) if self.uses[script].any() else np.arange(len(self.languages))
            table = self.table[:, candidates]
            for lo in range(0, len(own), 1 << 15):
                words = own[lo : lo + (1 << 15)]
                grams, at = W.ragged(c.grams, c.starts[words], c.starts[words + 1])
                found = WEIGHT * np.add.reduceat(table[grams], at[:-1])
                out[words] = found.min(axis=1, keepdims=True) - BARRED
                out[words[:, None], candidates] = found
        return out


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """The model of rows (doc_id, text, lang) with a language and a text; at most per_language of each, the first by hash of doc_id.

    The rows are counted and read once each, for all languages together.
    """
    known = docs.where("lang is not null and text is not null and text <> ''").select(F.col("doc_id").alias("d"), "text", "lang")
    total = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    languages = sorted(total)
    empty = Model(languages, np.zeros((CLASSES, len(languages)), np.float32), np.ones((len(NAMES), len(languages)), bool))
    if not languages:
        return empty
    h = F.pmod(F.xxhash64("d"), F.lit(SPAN)).alias("h")
    bounds = known.sparkSession.createDataFrame([(lang, k, hash_bound(per_language, total[lang])) for k, lang in enumerate(languages)], "lang string, k int, bound long")
    near = known.join(F.broadcast(bounds), "lang").select("k", "bound", h, "d", "text").where("h < bound")  # somewhat more than per_language of each
    first = Window.partitionBy("k").orderBy("h", "d", F.xxhash64("text"))
    sample = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).select("k", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in W.slices(batch):
                lang = part.column("k").to_numpy()
                flat, offsets = split(W.texts(part))
                index, distinct = W.encode(flat)
                c = coded(distinct)
                for k in np.unique(lang).tolist():
                    grams, scripts = sums.setdefault(k, (np.zeros(CLASSES), np.zeros(len(NAMES))))
                    times = np.bincount(index[np.repeat(lang == k, np.diff(offsets))], minlength=len(distinct))
                    times[c.letters == 0] = 0
                    grams += np.bincount(c.grams, weights=np.repeat(times, np.diff(c.starts)), minlength=CLASSES)
                    at = c.script >= 0
                    scripts += np.bincount(c.script[at], weights=(times * c.letters)[at], minlength=len(NAMES))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array([x[c].tobytes() for x in sums.values()], pa.binary()) for c in range(2))], names=["k", "grams", "scripts"])

    grams, scripts = np.zeros((CLASSES, len(languages))), np.zeros((len(NAMES), len(languages)))
    for r in sample.mapInArrow(count, "k int, grams binary, scripts binary").collect():  # a column of counts for each language
        grams[:, r.k] += np.frombuffer(r.grams)
        scripts[:, r.k] += np.frombuffer(r.scripts)
    table = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * CLASSES)).astype(np.float32)
    return Model(languages, table, scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0)))


def viterbi(score: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word; all texts advance together, longest first."""
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    begin, size = offsets[:-1][order], size[order]
    n, languages = len(score), score.shape[1] if score.ndim == 2 else 0
    came = np.full((n, languages), -1, np.int16)
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    best = score[begin[: active[0]]].copy() if steps else None
    final = np.zeros(len(size), np.int64)
    for t in range(1, steps):
        m = active[t]
        if m < len(best):
            final[m : len(best)] = best[m:].argmax(axis=1)
            best = best[:m]
        top = best.argmax(axis=1)
        switched = best[np.arange(m), top] - penalty
        jump = best < switched[:, None]
        at = begin[:m] + t
        came[at] = np.where(jump, top[:, None], -1)
        best = np.where(jump, switched[:, None], best) + score[at]
    if steps:
        final[: len(best)] = best.argmax(axis=1)
    label = np.zeros(n, np.int64)
    state = final.copy()
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        label[at] = state[:m]
        if t:
            back = came[at, state[:m]]
            state[:m] = np.where(back >= 0, back, state[:m])
    return label


def label(docs: DataFrame, model: Model, penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of every row; with spans also (first word, end word, language) of each span.

    The score is the share of letters in words of that language.  ``und`` and 0 if
    text is null or has no letter, or nothing was learned.  Ties go to the language
    first by name.  Repeated rows give a row each; other columns, whatever their names,
    are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        many = len(m.languages)
        for batch in batches:
            for part in W.slices(batch):
                flat, offsets = split(W.texts(part))
                index, distinct = W.encode(flat)
                c = coded(distinct)
                letters = c.letters[index] if len(index) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                if many and len(index):
                    found = viterbi(m.scores(c)[index], offsets, penalty)
                    share = np.bincount(doc * many + found, weights=letters, minlength=part.num_rows * many).reshape(-1, many)
                else:
                    found, share = np.zeros(len(index), np.int64), np.zeros((part.num_rows, max(1, many)))
                total = share.sum(axis=1)
                top = share.argmax(axis=1)
                pred = [m.languages[k] if t > 0 else "und" for k, t in zip(top.tolist(), total.tolist(), strict=True)]
                out = [part.column("doc_id"), pa.array(pred, pa.string()), pa.array(share.max(axis=1) / np.maximum(total, 1))]
                if spans:
                    edge = np.flatnonzero(np.concatenate(([True], (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])))) if len(found) else np.zeros(0, np.int64)
                    end = np.append(edge[1:], len(found)) if len(edge) else edge
                    own = [[] for _ in range(part.num_rows)]
                    for a, b in zip(edge.tolist(), end.tolist(), strict=True):
                        if many:
                            own[doc[a]].append({"first": a - int(offsets[doc[a]]), "end": b - int(offsets[doc[a]]), "lang": m.languages[found[a]]})
                    out.append(pa.array(own, pa.list_(pa.struct({"first": pa.int64(), "end": pa.int64(), "lang": pa.string()}))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "spans"][: len(out)])

    schema = "doc_id bigint, lang_pred string, score double" + ", spans array<struct<first: bigint, end: bigint, lang: string>>" * spans
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)
