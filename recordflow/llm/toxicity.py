"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

1. A bounded, hash-ordered sample of labelled rows (``per_label`` of each label)
   gives the examples.  All their words are terms; none is left out.
2. Document frequencies of the terms are counted over all documents.  A term
   weighs (1 + ln tf) * idf * rf^relevance; rf, the relevance frequency
   log2(2 + toxic / clean), says how many times more toxic than clean examples
   hold the term (relevance=0 is plain TF-IDF).
3. Examples are unit vectors in an inverted index whose lists are cut into
   blocks of examples.  Short lists are summed for every query.  Of long lists a
   block keeps only the largest weight until it is visited: blocks whose bound
   can't reach a query's nearest examples are skipped, so the neighbours are exact.
4. Neighbours vote with a power of their cosine, weighted to the natural share of
   the labels; a logistic fit on leave-one-out votes of the examples turns votes
   into probabilities and says which power foretells the labels best.  The
   neighbours and their cosines are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import first_by_hash, summed

#: Labelled rows of each label that are used at most.
PER_LABEL = 2000
#: Power of the relevance frequency in a term's weight.
RELEVANCE = 2.0
NEIGHBOURS = 32
#: Powers of the cosine that are tried.
POWERS = (1.0, 2.0, 4.0, 8.0)
#: Examples of a block, queries handled at once, and blocks that every query visits first.
BLOCK, QUERIES, FIRST = 64, 256, 4
#: Bytes of text handled at once.
SLICE = 2 << 20
#: A list is long if it has more than this share of the examples (and BLOCK of them).
LONG = 1 / 32

_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…“”„«»‘’¿¡"


def bags(text: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (text, term, count) of the texts' bags of words, by text and term.

    Words are lower-case, without punctuation at their ends.  A term is the word's
    hash, or its place among the wanted hashes (sorted); others are left out then.
    """
    flat, offsets = W.split(pc.utf8_lower(text))
    index, distinct = W.encode(flat)
    at, names = W.encode(pc.utf8_trim(distinct, _TRIM))
    one = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((one(w) if w else 0 for w in names.cast(pa.large_binary()).to_pylist()), np.uint64, len(names))
    if wanted is None:
        values, code = np.unique(hashes, return_inverse=True)
        code = np.where(hashes > 0, code, -1)
    else:
        values = np.arange(len(wanted))
        code = np.minimum(np.searchsorted(wanted, hashes), max(len(wanted) - 1, 0))
        code = np.where((hashes > 0) & (wanted[code] == hashes), code, -1) if len(wanted) else np.full(len(hashes), -1)
    if not len(index):
        return np.zeros(0, np.int64), values[:0], np.zeros(0, np.int64)
    term = code[at[index]]
    doc = np.repeat(np.arange(len(text)), np.diff(offsets))[term >= 0]
    key, count = np.unique(doc * len(values) + term[term >= 0], return_counts=True)
    return key // max(1, len(values)), values[key % max(1, len(values))], count


@dataclass
class Index:
    """Examples as unit vectors in inverted lists."""

    #: Hashes of the terms, ascending, and the factor of each: idf and relevance.
    terms: np.ndarray
    factor: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    weight: np.ndarray
    #: Lists by term: examples and weights, between starts[t] and starts[t + 1].
    starts: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    share: float
    slope: tuple[float, float, float] = (1.0, 0.0, 0.0)
    power: float = 1.0

    def prepare(self) -> None:
        """The long lists as a matrix, and their largest weights by block; once in each worker."""
        if hasattr(self, "long"):
            return
        size, n = np.diff(self.starts), len(self.ids)
        many = np.flatnonzero(size > max(BLOCK, LONG * n))
        self.long = np.full(len(self.terms), -1)
        self.long[many] = np.arange(len(many))
        self.blocks = -(-n // BLOCK)
        self.matrix = np.zeros((len(many), self.blocks * BLOCK))
        for row, t in enumerate(many.tolist()):
            a, b = self.starts[t], self.starts[t + 1]
            self.matrix[row, self.examples[a:b]] = self.weights[a:b]
        self.ceiling = self.matrix.reshape(len(many), self.blocks, BLOCK).max(axis=2)

    def vectors(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """Unit weights of bags' entries."""
        w = (1 + np.log(count)) * self.factor[term]
        return w / np.sqrt(np.maximum(np.bincount(doc, weights=w * w, minlength=n), 1e-24))[doc]

    def nearest(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, loo: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For each of n queries the k examples of largest positive cosine, ties by example, and the cosines.

        Examples are -1 where there are fewer.  loo: query i is example i and leaves itself out.
        """
        self.prepare()
        found, cosine = np.full((n, k), -1), np.zeros((n, k))
        for lo in range(0, n, QUERIES):
            m = min(QUERIES, n - lo)
            a, b = np.searchsorted(doc, (lo, lo + m))
            row, col, value = self._batch(doc[a:b] - lo, term[a:b], weight[a:b], m, k, np.arange(lo, lo + m) if loo else None)
            first = np.searchsorted(row, np.arange(m))
            place = np.arange(len(row)) - first[row]
            few = place < k
            found[lo + row[few], place[few]], cosine[lo + row[few], place[few]] = col[few], np.minimum(value[few], 1.0)
        return found, cosine

    def _batch(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, m: int, k: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = self.blocks * BLOCK
        place = self.long[term]
        short = place < 0
        t, size = term[short], np.diff(self.starts)[term[short]]
        at = np.arange(int(size.sum())) + np.repeat(self.starts[t] - np.cumsum(size) + size, size)
        score = np.bincount(np.repeat(doc[short], size) * width + self.examples[at], weights=np.repeat(weight[short], size) * self.weights[at], minlength=m * width).reshape(m, width)
        query = np.zeros((m, len(self.matrix)))
        query[doc[~short], place[~short]] = weight[~short]
        bound = query @ self.ceiling + score.reshape(m, self.blocks, BLOCK).max(axis=2)
        exact = np.zeros((m, width))

        def visit(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows, span = np.flatnonzero(wanted[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                exact[rows, span] = score[rows, span] + query[rows] @ self.matrix[:, span]
            if own is not None:
                exact[np.arange(m), own] = 0

        first = np.zeros((m, self.blocks), bool)
        first[np.arange(m)[:, None], np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]] = True
        visit(first)
        floor = -np.partition(-exact, min(k, width) - 1, axis=1)[:, min(k, width) - 1]
        visit((bound > 0) & (bound >= floor[:, None] - 1e-9) & ~first)
        floor = -np.partition(-exact, min(k, width) - 1, axis=1)[:, min(k, width) - 1]
        row, col = np.nonzero((exact > 1e-12) & (exact >= floor[:, None]))
        value = exact[row, col]
        order = np.lexsort((col, -value, row))
        return row[order], col[order], value[order]

    def votes(self, found: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The toxic share of the votes, with a small vote of the natural share; the largest cosine."""
        w = np.where(found >= 0, cosine**self.power * self.weight[found], 0.0)
        few = 0.05**self.power
        return ((w * self.labels[found]).sum(axis=1) + few * self.share) / (w.sum(axis=1) + few), cosine.max(axis=1, initial=0.0)

    def probability(self, vote: np.ndarray, top: np.ndarray) -> np.ndarray:
        a, b, c = self.slope
        vote = np.clip(vote, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(a * np.log(vote / (1 - vote)) + b * top + c, -30, 30)))


def sampled(labels: DataFrame, per_label: int, counted: dict[int, int]) -> DataFrame:
    """One row per doc_id with its label (toxic if any row says so), per_label of each, the first by hash."""
    each = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [first_by_hash(each.where(F.col("toxic") == y), ["doc_id"], per_label, counted[y]) for y in (0, 1)]
    return parts[0].union(parts[1])


def _example_terms(docs: DataFrame, sample: DataFrame) -> list:
    """doc_id, toxic, terms (hashes), counts of the sampled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, most=SLICE):
                doc, term, count = bags(W.texts(part))
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
                found = [(term[a:b].tobytes(), count[a:b].astype("<u4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *(pa.array(c, pa.binary()) for c in zip(*found, strict=True))], names=["doc_id", "toxic", "terms", "counts"])

    joined = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")  # the sample has 2 x per_label rows at most
    return joined.mapInArrow(run, "doc_id bigint, toxic int, terms binary, counts binary").collect()


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, over all of them, and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        wanted = shared.value
        total = np.zeros(len(wanted) + 1, np.int64)
        for batch in batches:
            for part in W.slices(batch, most=SLICE):
                total[:-1] += np.bincount(bags(W.texts(part), wanted)[1], minlength=len(wanted))
                total[-1] += part.num_rows
        return total

    out = summed(docs.select("text"), count, len(terms) + 1)
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, relevance: float = RELEVANCE) -> Index | None:
    """The index and its calibration; None without rows of both labels that have a word.

    Labels other than 0 and 1, rows without a doc_id and labels of unknown documents are
    not learned from.  A doc_id with several labels is toxic if one says so; equal bags
    of words are one example with their mean label.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = {r[0]: r[1] for r in labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).groupBy("toxic").count().collect()}
    if len(counted) < 2:
        return None
    seen: dict[tuple, list] = {}
    for r in _example_terms(docs, sampled(labels, per_label, counted)):
        if len(r.terms):
            seen.setdefault((bytes(r.terms), bytes(r.counts)), []).append((r.doc_id, r.toxic))
    groups = sorted(((min(d for d, _ in group), terms, counts, group) for (terms, counts), group in seen.items()), key=lambda g: g[:3])
    toxic = np.array([np.mean([y for _, y in g[3]]) for g in groups])
    size = np.array([len(g[3]) for g in groups], float)
    n = np.array([(size * (1 - toxic)).sum(), (size * toxic).sum()])
    if not len(groups) or not n.all():
        return None
    natural = np.array([counted[0] / n[0], counted[1] / n[1]])
    weight = size * (natural[0] * (1 - toxic) + natural[1] * toxic)
    labels_of = size * toxic * natural[1] / weight
    doc = np.repeat(np.arange(len(groups)), [len(g[1]) // 8 for g in groups])
    terms, term = np.unique(np.frombuffer(b"".join(g[1] for g in groups), np.uint64), return_inverse=True)
    count = np.frombuffer(b"".join(g[2] for g in groups), "<u4").astype(float)
    df, total = document_frequencies(docs, terms)
    up, down = np.bincount(term, weights=toxic[doc], minlength=len(terms)), np.bincount(term, weights=1 - toxic[doc], minlength=len(terms))
    rf = np.log2(2 + up / np.maximum(1, down * min(1.0, n[1] / n[0])))
    factor = (np.log((1 + total) / (1 + df)) + 1) * rf**relevance
    index = Index(terms, factor, np.array([g[0] for g in groups]), labels_of, weight, *[np.zeros(0, np.int64)] * 3, share=counted[1] / (counted[0] + counted[1]))
    value = index.vectors(doc, term, count, len(groups))
    # examples that lean on the same frequent term share blocks
    often = np.where(np.bincount(term, minlength=len(terms))[term] > LONG * len(groups), value, 0)
    best = np.lexsort((often, doc))[np.searchsorted(doc, np.arange(len(groups)), side="right") - 1]
    order = np.lexsort((index.ids, term[best]))
    index.ids, index.labels, index.weight = index.ids[order], index.labels[order], index.weight[order]
    doc = np.argsort(order)[doc]
    by = np.lexsort((doc, term))
    index.examples, index.weights, index.starts = doc[by], value[by], np.searchsorted(term[by], np.arange(len(terms) + 1))
    by = np.lexsort((term, doc))
    _calibrate(index, doc[by], term[by], value[by])
    return index


def _calibrate(index: Index, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
    """Power of the cosine and logistic fit with the least loss on the examples' leave-one-out votes."""
    found, cosine = index.nearest(doc, term, value, len(index.ids), NEIGHBOURS, loo=True)
    y, w = index.labels, index.weight / index.weight.mean()
    prior = np.diag([1.0, 1.0, 1e-2])
    best = None
    for power in POWERS:
        index.power = power
        vote, top = index.votes(found, cosine)
        vote = np.clip(vote, 1e-6, 1 - 1e-6)
        x = np.stack([np.log(vote / (1 - vote)), top, np.ones(len(top))], axis=1)
        beta = np.array([1.0, 0.0, 0.0])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            hessian = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + prior
            beta = beta - np.clip(np.linalg.solve(hessian, x.T @ (w * (p - y)) + prior @ (beta - [1.0, 0.0, 0.0])), -1, 1)
        z = np.clip(x @ beta, -30, 30)
        loss = float((w * (np.logaddexp(0, z) - y * z)).sum())
        if best is None or loss < best[0]:
            best = (loss, power, tuple(float(b) for b in beta))
    _, index.power, index.slope = best


def _scored(index: Index | None, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, evidence (examples, -1: none) and cosines of each text."""
    n = len(text)
    if index is None:
        return np.zeros(n), np.full((n, 0), -1), np.zeros((n, 0))
    doc, term, count = bags(text, index.terms)
    found, cosine = index.nearest(doc, term, index.vectors(doc, term, count, n), n, NEIGHBOURS)
    return index.probability(*index.votes(found, cosine)), found, cosine


def score(docs: DataFrame, index: Index | None) -> DataFrame:
    """doc_id, score, predicted, evidence (ids of the nearest examples), cosines for every row.

    Every text that shares a word with an example has evidence.  Null and empty
    texts, and texts that share none, have the score of a text without neighbours.
    Without an index all scores are 0.  Ties of the cosine go by example; repeated
    rows give a row each; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, most=SLICE):
                s, found, cosine = _scored(shared.value, W.texts(part))
                keep = found >= 0
                offsets = pa.array(np.concatenate(([0], np.cumsum(keep.sum(axis=1)))), pa.int32())
                ids = shared.value.ids[found[keep]] if shared.value else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(cosine[keep]))],
                    names=["doc_id", "score", "predicted", "evidence", "cosines"],
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int, evidence array<bigint>, cosines array<double>")


def keep_clean(docs: DataFrame, index: Index | None) -> DataFrame:
    """The rows of docs whose text is not predicted toxic, unchanged, all columns; null and empty texts stay unless a text without neighbours is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, most=SLICE):
                yield part.filter(pa.array(_scored(shared.value, W.texts(part))[0] < 0.5))

    return docs.mapInArrow(run, docs.schema)
