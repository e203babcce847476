"""Substring dedup by repeated-phrase automata.

A window is ``size`` consecutive words of one document; a word goes if a window
over it also starts earlier (smaller doc_id, or same document and earlier).

1. Copies (equal word sequences) are collapsed: all windows of a later copy start
   earlier in the first one.
2. Every window has an anchor, the smallest hash of the ANCHOR-word phrases in it
   (leftmost of equal ones), so equal windows have equal anchors.  Anchors that
   occur once cannot stand in a repeated window.
3. A recurring anchor belongs to the stretch of STRETCH words in which it stands
   first.  A document's neighbouring windows with anchors of one such stretch are
   one passage, so a passage is sent where all its partners are.  Anchors that recur
   very often are taken window by window, so that their passages spread.
4. Confirm: equal passages are counted; a shard of passages finds the windows that
   recur and where they stand first.  These are its phrases.
5. Compile and stream: every shard's phrases become an Aho-Corasick automaton over
   words as symbols, and the passages of all documents stream through the automata
   of their shards, those of a frequent phrase in several tasks.  Hits are compared
   by their words' hashes; those after a phrase's first place are what goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .store import cut, drop, small, tidy

#: Words of an anchor phrase.
ANCHOR = 12
#: Occurrences from which an anchor's windows are taken one by one.
FREQUENT = 20_000
#: Documents of one batch from which an anchor counts as frequent without further ado.
HOT = 64
#: Words of the first document that make one passage key.
STRETCH = 256
#: Words of a shard's passages, about, and occurrences of its phrases that one automaton streams, about.
SHARD_WORDS, STREAM = 100_000, 50_000

_EMPTY = hashlib.sha256(b"").hexdigest()


def _anchors(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of every text: its place in the flat words, and its anchor's hash and place."""
    count = np.maximum(np.diff(offsets) - size + 1, 0)
    if not count.sum():
        return (np.zeros(0, np.int64),) * 3
    start = np.repeat(offsets[:-1] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    g = W.grams(hashes, ANCHOR)
    span = size - ANCHOR + 1
    views = np.lib.stride_tricks.sliding_window_view(g, span)
    out = np.empty(len(start), np.int64)
    for a in range(0, len(start), 1 << 18):
        out[a : a + (1 << 18)] = views[start[a : a + (1 << 18)]].argmin(axis=1)
    place = start + out
    return start, g[place], place


def _runs(value: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    return np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1], [True]))) if len(value) else np.zeros(1, np.int64)


def word_table(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_words, sha (of the words joined by a space), anchors and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                flat, offsets = W.split(W.texts(part))
                start, anchor, place = _anchors(W.word_hashes(flat), offsets, size)
                first = _runs(place)[:-1] if len(place) else np.zeros(0, np.int64)
                at = np.searchsorted(start[first], offsets) if len(place) else np.zeros(len(offsets), np.int64)
                sha = [hashlib.sha256(t).hexdigest() for t in joined(flat, offsets)]
                place = place[first] - np.repeat(offsets[:-1], np.diff(at))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(c.astype(np.int64))) for c in (anchor[first], place)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(sha), *lists], names=["doc_id", "n_words", "sha", "anchors", "places"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, sha string, anchors array<bigint>, places array<bigint>")


def joined(flat: pa.Array, offsets: np.ndarray) -> list[bytes]:
    """Each text's words with one space between."""
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), flat.cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist()


def recurring(heads: DataFrame) -> DataFrame:
    """head, anchors, places -> doc_id, found: the document's anchors that occur twice or more, with their passage key, null for frequent ones.

    A batch sends an anchor on once, with its local count, its first place and its
    documents; those of a locally frequent anchor go under keys of their own.  So an
    anchor of a third of all documents reaches its task as one short row a batch.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("anchors")
            anchor, place = lists.flatten().to_numpy(), batch.column("places").flatten().to_numpy()
            doc = np.repeat(batch.column("head").to_numpy(), np.diff(np.asarray(lists.offsets)))
            order = np.lexsort((place, doc, anchor))
            anchor, doc, place = anchor[order], doc[order], place[order]
            at = _runs(anchor)
            first, count = at[:-1], np.diff(at)
            new = np.append(True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])) if len(doc) else np.zeros(0, bool)
            upto = np.append(0, np.cumsum(new))
            docs = pa.ListArray.from_arrays(pa.array(upto[at], pa.int32()), pa.array(doc[new]))
            hot = count >= HOT
            none = pa.array([[]] * int(hot.sum()), pa.list_(pa.int64()))
            key = np.concatenate([anchor[first], W.mix(anchor[first[hot]].astype(np.uint64) ^ W.mix(doc[first[hot]].astype(np.uint64), 3), 11).astype(np.int64)])
            sent = pa.concat_arrays([docs.filter(pa.array(~hot)), none, docs.filter(pa.array(hot))])
            own = np.concatenate([np.flatnonzero(~hot), np.flatnonzero(hot), np.flatnonzero(hot)])  # the row of each list above
            key = np.concatenate([anchor[first[~hot]], anchor[first[hot]], key[len(first) :]])
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c[own]) for c in (anchor[first], count, doc[first], place[first], hot)), sent], names=["key", "anchor", "n", "doc", "place", "hot", "docs"])

    local = heads.select("head", "anchors", "places").mapInArrow(combine, "key bigint, anchor bigint, n bigint, doc bigint, place bigint, hot boolean, docs array<bigint>")
    over = Window.partitionBy("key")
    lead = F.min(F.struct("doc", "place")).over(over)
    known = local.select("anchor", "docs", F.sum("n").over(over).alias("n"), F.max("hot").over(over).alias("hot"), lead.alias("lead")).where("n > 1")
    passage = F.when(~F.col("hot") & (F.col("n") < FREQUENT), F.xxhash64("lead.doc", F.floor(F.col("lead.place") / STRETCH)))
    return known.withColumn("passage", passage).select(F.struct("anchor", "passage").alias("found"), F.explode("docs").alias("doc_id")).groupBy("doc_id").agg(F.collect_list("found").alias("found"))


def passages(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text, found -> key, doc_id, start, size (in words), words: each run of windows with anchors of one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                flat, offsets = W.split(W.texts(part))
                hashes = W.word_hashes(flat)
                start, anchor, _ = _anchors(hashes, offsets, size)
                whole = W.grams(hashes, size).astype(np.int64)
                at, signed = np.searchsorted(start, offsets), anchor.astype(np.int64)
                lists = part.column("found")
                found, cuts = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
                name, key = found.field("anchor").to_numpy(), found.field("passage")
                often, key = pc.is_null(key).to_numpy(zero_copy_only=False), pc.fill_null(key, 0).to_numpy()
                rows: list[list[np.ndarray]] = [[], [], [], []]  # key, document, first word and end
                for d in range(part.num_rows):
                    own = signed[at[d] : at[d + 1]]
                    mine = slice(int(cuts[d]), int(cuts[d + 1]))
                    order = np.argsort(name[mine], kind="stable")
                    sorted_ = name[mine][order]
                    if not len(own) or not len(sorted_):
                        continue
                    place = np.minimum(np.searchsorted(sorted_, own), len(sorted_) - 1)
                    hit = sorted_[place] == own
                    each = hit & often[mine][order][place]
                    k = np.where(each, whole[start[at[d] : at[d + 1]]], key[mine][order][place])
                    new = hit & np.append(True, (k[1:] != k[:-1]) | ~hit[:-1] | each[1:] | each[:-1])
                    begin = np.flatnonzero(new)
                    last = np.flatnonzero(hit & np.append(new[1:] | ~hit[1:], True))
                    for column, value in zip(rows, (k[begin], np.full(len(begin), d), start[at[d]] + begin, start[at[d]] + last + size), strict=True):
                        column.append(value)
                k, d, a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in rows)
                wide, upto = W.ragged(np.arange(len(flat)), a, b)
                words = joined(flat.take(pa.array(wide)), upto)
                yield pa.RecordBatch.from_arrays([pa.array(k), part.column("doc_id").take(pa.array(d)), pa.array(a - offsets[d]), pa.array(b - a), pa.array(words, pa.binary()).cast(pa.string())], names=["key", "doc_id", "start", "size", "words"])

    return docs.select("doc_id", "text", "found").mapInArrow(run, "key bigint, doc_id bigint, start bigint, size bigint, words string")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows -> one batch for each run of equal values in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in range(keys)]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
            if held and now != (this := tuple(c[a] for c in columns)):
                yield pa.concat_batches(held)
                held = []
            now = tuple(c[a] for c in columns)
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def phrases(counted: DataFrame, size: int) -> DataFrame:
    """shard, words, n, doc_id, start of distinct passages, dealt out by shard -> shard, n, words, offsets, docs, starts.

    A row holds the phrases of one shard: windows that recur, as offsets into a
    passage's words, and where each stands first.  n says how often they stand in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _groups(batches, 1):
            flat, offsets = W.split(own.column("words").cast(pa.large_string()))
            many = np.diff(offsets) - size + 1
            passage = np.repeat(np.arange(len(many)), many)
            offset = np.arange(len(passage)) - np.repeat(np.cumsum(many) - many, many)
            window = W.grams(W.word_hashes(flat), size)[offsets[passage] + offset]
            times, doc, begin = (own.column(c).to_numpy() for c in ("n", "doc_id", "start"))
            begin = begin[passage] + offset
            order = np.lexsort((begin, doc[passage], window))
            at = _runs(window[order])
            count = np.add.reduceat(times[passage[order]], at[:-1])
            first = np.sort(order[at[:-1][count > 1]])  # a phrase is shown where it stands first
            if not len(first):
                continue
            here, cuts = passage[first], _runs(passage[first])
            lists = lambda x, cuts=cuts: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x))
            inner = pa.StructArray.from_arrays([own.column("words").take(pa.array(here[cuts[:-1]])), *(lists(x) for x in (offset[first], doc[here], begin[first]))], names=["words", "offsets", "docs", "starts"])
            yield pa.RecordBatch.from_arrays([own.column("shard").slice(0, 1), pa.array([int(count[count > 1].sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)], names=["shard", "n", "phrases"])

    return counted.mapInArrow(run, "shard bigint, n bigint, phrases array<struct<words: string, offsets: array<bigint>, docs: array<bigint>, starts: array<bigint>>>")


def _symbols(hashes: np.ndarray) -> np.ndarray:
    """A character for each word; few words share one, and hits are compared by the whole hashes."""
    s = (hashes % np.uint64(0x10F000)).astype(np.uint32) + 1
    return np.where(s < 0xD800, s, s + 0x800).astype("<u4")


class Phrases:
    """A shard's automaton: confirmed windows as strings of symbols."""

    def __init__(self, shown: list[dict], size: int):
        self.size = size
        flat, offsets = W.split(pa.array([p["words"] for p in shown], pa.large_string()))
        hashes = W.word_hashes(flat)
        at = np.concatenate([offsets[k] + np.array(p["offsets"], np.int64) for k, p in enumerate(shown)])
        self.hash = W.grams(hashes, size)[at]
        self.doc, self.start = (np.concatenate([np.array(p[c], np.int64) for p in shown]) for c in ("docs", "starts"))
        text = _symbols(hashes).tobytes().decode("utf-32-le")
        self.automaton = ahocorasick.Automaton()
        #: Phrases whose symbols are those of another one.
        self.twins: dict[int, list[int]] = {}
        for i, a in enumerate(at.tolist()):
            coded = text[a : a + size]
            if (other := self.automaton.get(coded, None)) is None:
                self.automaton.add_word(coded, i)
            else:
                self.twins.setdefault(other, []).append(i)
        self.automaton.make_automaton()

    def hits(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, offset, phrase) of every occurrence of a phrase in passages of words."""
        flat, offsets = W.split(words)
        hashes = W.word_hashes(flat)
        stream = np.insert(_symbols(hashes), offsets[1:-1], 0).tobytes().decode("utf-32-le")  # 0, no word's symbol, parts passages
        found = np.array(list(self.automaton.iter(stream)), np.int64).reshape(-1, 2)
        begins = offsets[:-1] + np.arange(len(offsets) - 1)
        place, phrase = found[:, 0] - self.size + 1, found[:, 1]
        passage = np.searchsorted(begins, place, side="right") - 1
        window = W.grams(hashes, self.size)[place - passage]
        for other, twins in self.twins.items():
            for k in np.flatnonzero((phrase == other) & (window != self.hash[phrase])).tolist():
                phrase[k] = next((t for t in twins if self.hash[t] == window[k]), other)
        real = self.hash[phrase] == window
        return passage[real], (place - begins[passage])[real], phrase[real]


def locate(streams: DataFrame, size: int) -> DataFrame:
    """shard, salt, then either phrases or doc_id, start, words, dealt out and sorted with the phrases first -> doc_id, starts.

    starts: words of the document at which a phrase begins that also begins earlier.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, compiled = None, None
        for batch in batches:
            for own in _groups(iter([batch]), 2):
                this = (own.column("shard")[0].as_py(), own.column("salt")[0].as_py())
                if this != now:
                    now, shown = this, own.column("phrases")[0].as_py()
                    compiled = Phrases(shown, size) if shown else None
                own = own.filter(pc.is_valid(own.column("words")))
                if compiled is None or not own.num_rows:
                    continue
                passage, offset, phrase = compiled.hits(own.column("words").cast(pa.large_string()))
                doc, place = own.column("doc_id").to_numpy()[passage], own.column("start").to_numpy()[passage] + offset
                later = (doc > compiled.doc[phrase]) | (doc == compiled.doc[phrase]) & (place > compiled.start[phrase])
                doc, place = doc[later], place[later]
                cuts = _runs(passage[later])
                yield pa.RecordBatch.from_arrays([pa.array(doc[cuts[:-1]]), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(place))], names=["doc_id", "starts"])

    return streams.mapInArrow(run, "doc_id bigint, starts array<bigint>")


def repeated_windows(docs: DataFrame, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words, sha, copy) of every row, and (doc_id, starts): windows that also start earlier.

    ``copy`` marks rows whose whole word sequence stands in an earlier row; they are not in the second table.
    """
    table = cut(word_table(docs, size), "words")
    held = table.where(f"n_words >= {size} and doc_id is not null")
    heads = held.groupBy("sha").agg(F.min("doc_id").alias("head"), F.min_by(F.struct("anchors", "places"), "doc_id").alias("own")).select("head", "own.*")
    found = cut(recurring(heads), "found")
    rows = cut(table.select("doc_id", "n_words", "sha"), "rows")
    drop(table)
    copied = rows.where(f"n_words >= {size} and doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    copied = cut(copied, "copied")
    reach = cut(passages(docs.join(found, "doc_id"), size), "passages")
    drop(found)
    shards = max(1, int(reach.agg(F.sum("size")).first()[0] or 0) // SHARD_WORDS)
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    counted = reach.groupBy(shard, "words").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first"))
    dealt = counted.select("shard", "words", "n", "first.*").repartition("shard").sortWithinPartitions("shard")
    confirmed = cut(phrases(dealt, size), "phrases")
    # a shard's passages stream through as many copies of its automaton as they need
    salts = confirmed.select("shard", F.ceil(F.col("n") / STREAM).cast("long").alias("salts"))
    streamed = reach.select(shard, "doc_id", "start", "words").join(small(salts.where("salts > 1")), "shard", "left")
    streamed = streamed.select("shard", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).alias("salt"), F.lit(None).cast(confirmed.schema["phrases"].dataType).alias("phrases"), "doc_id", "start", "words")
    copies = confirmed.select("shard", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / STREAM).cast("long") - 1)).alias("salt"), "phrases", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("string").alias("words"))
    order = copies.unionByName(streamed).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("phrases").isNull())
    starts = cut(locate(order, size).groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts")), "starts")
    drop(reach)
    drop(confirmed)
    marked = rows.join(small(copied), "sha", "left").select("doc_id", "n_words", "sha", F.coalesce(F.col("doc_id") > F.col("head"), F.lit(False)).alias("copy"))
    return marked, starts


def _covered(n: int, starts: list[int], size: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    s = np.array(starts, np.int64)
    np.add.at(edge, s, 1)
    np.add.at(edge, np.minimum(s + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def cut_texts(docs: DataFrame, starts: DataFrame, size: int) -> DataFrame:
    """doc_id, n_removed, kept (the words that stay, one space between) of the documents in starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                flat, offsets = W.split(W.texts(part))
                removed, kept = [], []
                keep = np.ones(len(flat), bool)
                for d, own in enumerate(part.column("starts").to_pylist()):
                    a, b = int(offsets[d]), int(offsets[d + 1])
                    keep[a:b] = ~_covered(b - a, own or [], size)
                    removed.append(b - a - int(keep[a:b].sum()))
                upto = np.concatenate(([0], np.cumsum(keep)))
                kept = joined(flat.filter(pa.array(keep)), upto[offsets])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_removed", "kept"])

    return docs.join(starts, "doc_id").select("doc_id", "text", "starts").mapInArrow(run, "doc_id bigint, n_removed bigint, kept string")


@tidy
def dedup_substrings(docs: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text).

    Nulls and texts of fewer than ``size`` words lose nothing.  Rows that repeat a
    doc_id with other words are one document of the smallest place; an equal row
    of the same doc_id loses nothing.  Rows without a doc_id lose nothing.  Other
    columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, starts = repeated_windows(docs, size)
    changed = cut_texts(docs, starts, size).select("doc_id", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    changed = changed.groupBy("doc_id").agg(F.max("n_removed").alias("n_removed"), F.max_by("kept_sha256", "n_removed").alias("kept_sha256"))
    out = rows.join(changed, "doc_id", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


@tidy
def without_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """docs with the repeated words cut out of text; texts that lose nothing stay as they are, to the character.

    A text whose words all go is empty.  Nulls, empty texts, rows without a doc_id and
    all other columns, whatever their names, stay; every row gives a row.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, starts = repeated_windows(slim, size)
    changed = cut_texts(slim, starts, size).where("n_removed > 0").select("doc_id", "kept")
    copies = rows.where("copy").select("doc_id", F.lit("").alias("kept"))
    changed = changed.union(copies).groupBy("doc_id").agg(F.min("kept").alias("kept"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return whole.join(changed, "doc_id", "left").select(F.col("row").withField("text", F.coalesce("kept", "row.text")).alias("row")).select("row.*")
