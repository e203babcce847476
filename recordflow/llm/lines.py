"""Repeated lines, found by two Bloom filters before anything is compared exactly.

1. Every document adds the hashes of its distinct lines to a filter of cells that
   remember "seen once" and "seen twice".  Tasks send which cells they met once or more
   often; cells are summed by segment, so a line that stands everywhere costs no
   more than another.  The filter has CELLS cells for each line that the texts can hold, and is as
   large as the corpus needs, because its segments lie in many tasks.
2. The cells seen twice are the second filter.  Few cells are, so it is folded to at most
   ``folded`` cells, which every task can hold.
3. Lines whose cells were all seen twice are suspects.  Only they are sent on: digest,
   documents and largest id, added up within a task first.  The digests (128 bits, BLAKE2) decide
   exactly which lines stand in enough documents, and the largest id is the one that keeps them.
4. Texts lose those lines.  Up to ``held`` lines go to all tasks; of more only the most
   frequent do, and documents meet the others in a join by digest and then by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import free_name
from . import words as W
from .store import cut, tidy

#: Cells of the filter for each line, cells of a line, and cells of a segment.
CELLS, PROBES, SEGMENT = 16, 3, 1 << 22
#: Cells of the folded second filter at most (32 MB), and lines that every task may hold.
FOLDED, HELD = 1 << 28, 250_000
#: Cells that a task holds before it sends them.
WAITING = 1 << 20

_BLANKS = " \t\n\x0b\x0c\r"


def lines(text: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Lines of all texts in one array, the offsets of each text in it, and the lines' keys: stripped, A-Z in lower case."""
    found = pc.split_pattern(text, "\n")
    offsets = np.asarray(found.offsets).astype(np.int64)
    flat = found.values
    return flat, offsets, pc.ascii_lower(pc.utf8_trim(flat, _BLANKS))


def _distinct(part: pa.RecordBatch, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys of at least `least` code points in a batch, each once, and the pairs (key, row) of those that stand in a row, each once."""
    _, offsets, keys = lines(W.texts(part))
    of = np.repeat(np.arange(part.num_rows), np.diff(offsets))
    at = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), least).to_numpy(zero_copy_only=False))
    index, distinct = W.encode(keys.take(pa.array(at)))
    pairs = np.unique(index.astype(np.int64) * part.num_rows + of[at])
    return distinct, pairs // max(1, part.num_rows), pairs % max(1, part.num_rows)


def _hashes(keys: pa.Array) -> np.ndarray:
    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(k) for k in keys.cast(pa.large_binary()).to_pylist()), np.uint64, len(keys))


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """PROBES cells of each hash."""
    return np.stack([(W.mix(hashes, k + 1) & np.uint64(cells - 1)).astype(np.int64) for k in range(PROBES)], axis=1)


def _bits(cells: np.ndarray, size: int) -> bytes:
    mask = np.zeros(size, bool)
    mask[cells] = True
    return np.packbits(mask, bitorder="little").tobytes()


def _by_segment(cells: np.ndarray, times: np.ndarray, segment: int) -> Iterator[pa.RecordBatch]:
    """Rows (segment, cells met once, cells met more often) of sorted cells."""
    of = cells // segment
    heads = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    ends = np.concatenate((heads[1:], [len(of)]))
    pack = lambda a, b, more: (cells[a:b][(times[a:b] > 1) == more] % segment).astype(np.uint32).tobytes()
    for k in range(0, len(heads), 256):
        some = list(zip(heads[k : k + 256].tolist(), ends[k : k + 256].tolist(), strict=True))
        rows = [pa.array([int(of[a]) for a, _ in some]), *(pa.array([pack(a, b, more) for a, b in some], pa.binary()) for more in (False, True))]
        yield pa.RecordBatch.from_arrays(rows, names=["segment", "once", "twice"])


def cells_for(docs: DataFrame, least: int) -> int:
    """A power of two of at least CELLS cells for each line of `least` code points that the texts can hold, newlines counted."""
    total = docs.agg(F.sum((F.char_length("text") + 1).cast("bigint"))).first()[0] or 0
    return 1 << max(10, (CELLS * (total // (max(1, least) + 1) + 1) - 1).bit_length())


def seen_twice(docs: DataFrame, least: int, cells: int, folded: int = FOLDED) -> np.ndarray:
    """Bits of the second filter: cells, folded to `folded`, that lines of two documents met."""
    segment, folded = min(SEGMENT, cells, folded), min(folded, cells)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return found, np.bincount(at, np.concatenate([n for _, n in held]), len(found)).clip(max=2)

        for batch in batches:
            for part in W.slices(batch):
                keys, key, _ = _distinct(part, least)
                documents = np.bincount(key, minlength=len(keys)).clip(max=2)
                held.append((_cells(_hashes(keys), cells).ravel(), np.repeat(documents, PROBES)))
                if sum(len(c) for c, _ in held) > WAITING:
                    held = [added()]
                    if len(held[0][0]) > WAITING // 2:
                        yield from _by_segment(*held.pop(), segment)
        if held:
            yield from _by_segment(*added(), segment)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One segment after another."""
        now, once, twice = -1, np.zeros(segment, bool), np.zeros(segment, bool)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now * segment % folded // segment]), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], names=["place", "bits"])
        for batch in batches:
            for k, a, b in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice")), strict=True):
                if k != now:
                    if twice.any():
                        yield row()
                    now = k
                    once[:] = twice[:] = False
                single, more = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                twice[single[once[single]]] = True
                twice[more] = True
                once[single] = True
                once[more] = True
        if twice.any():
            yield row()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = -1, np.zeros(0, np.uint8)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bits.tobytes()], pa.binary())], names=["place", "bits"])
        for batch in batches:
            for k, b in zip(batch.column("place").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                if k != now:
                    if len(bits):
                        yield row()
                    now, bits = k, np.zeros(-(-segment // 8), np.uint8)
                bits |= np.frombuffer(b, np.uint8)
        if len(bits):
            yield row()

    together = lambda df, key: df.repartition(key).sortWithinPartitions(key)
    found = together(docs.select("text").mapInArrow(met, "segment bigint, once binary, twice binary"), "segment").mapInArrow(fill, "place bigint, bits binary")
    if cells > folded:
        found = together(found, "place").mapInArrow(fold, "place bigint, bits binary")
    out = np.zeros(folded // 8, np.uint8)
    for batch in found.toArrow().to_batches():  # folded / 8 bytes at most
        for at, bits in zip(batch.column("place").to_pylist(), batch.column("bits"), strict=True):
            own = np.frombuffer(bits.as_buffer(), np.uint8)
            out[at * segment // 8 :][: len(own)] |= own
    return out


def _suspects(keys: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Places of keys whose cells were all seen twice."""
    if not len(keys):
        return np.zeros(0, np.int64)
    at = _cells(_hashes(keys), 8 * len(bits))
    return np.flatnonzero(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1))


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _digests(keys: pa.Array) -> list[bytes]:
    return list(map(_digest, keys.cast(pa.large_binary()).to_pylist()))


def repeated_lines(docs: DataFrame, bits, least: int, least_docs: int) -> DataFrame:
    """digest, n (documents) and keeper (largest doc_id) of the lines that stand in at least least_docs documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                keys, key, row = _distinct(part, least)
                some = _suspects(keys, bits.value)
                ids = part.column("doc_id").take(pa.array(row))
                by = pa.table({"key": pa.array(key), "id": ids}).group_by("key").aggregate([("id", "max"), ("id", "count", pc.CountOptions(mode="all"))]).sort_by("key")
                at = pa.array(some)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(_digests(keys.take(at)), pa.binary()), by.column("id_count").take(at).combine_chunks(), by.column("id_max").take(at).combine_chunks()], names=["digest", "n", "keeper"])

    found = docs.select("doc_id", "text").mapInArrow(run, "digest binary, n bigint, keeper bigint")
    return found.groupBy("digest").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")).where(F.col("n") >= least_docs)


def _own_drops(docs: DataFrame, lines_: DataFrame, bits, least: int) -> DataFrame:
    """doc_id, sig and drops (digests that go) of documents with lines of lines_ (digest, keeper); a join by digest, of which no digest has many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                keys, key, row = _distinct(part, least)
                some = np.isin(key, _suspects(keys, bits.value))
                if some.any():
                    used, at = np.unique(key[some], return_inverse=True)
                    digests = pa.array(_digests(keys.take(pa.array(used))), pa.binary()).take(pa.array(at))
                    rows = pa.array(row[some])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), part.column("sig").take(rows), digests], names=["doc_id", "sig", "digest"])

    found = docs.select("doc_id", F.xxhash64("text").alias("sig"), "text").mapInArrow(run, "doc_id bigint, sig bigint, digest binary")
    gone = found.join(lines_, "digest").where("doc_id is null and keeper is not null or doc_id <> keeper")
    return gone.groupBy("doc_id", "sig").agg(F.collect_set("digest").alias("drops"))


def _without(name: str, own: str | None, keepers, least: int, id_: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches without the lines that go: those of keepers kept elsewhere, and those that a row's own list names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = keepers.value
        firsts = np.sort(np.fromiter((int.from_bytes(d[:8], "little") for d in known), np.uint64, len(known)))
        for batch in batches:
            for part in W.slices(batch, name):
                flat, offsets, keys = lines(W.texts(part, name))
                ids = part.column(id_).to_pylist()
                lists = part.column(own).to_pylist() if own else [None] * len(ids)
                of = np.repeat(np.arange(len(ids)), np.diff(offsets))
                stay = np.ones(len(flat), bool)
                at = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), least).to_numpy(zero_copy_only=False))
                index, distinct = W.encode(keys.take(pa.array(at)))
                digests = _digests(distinct)
                head = np.fromiter((int.from_bytes(d[:8], "little") for d in digests), np.uint64, len(digests))
                listed = np.array([bool(x) for x in lists])
                for p in np.flatnonzero(np.isin(head, firsts)[index] | listed[of[at]]):
                    i, d = of[at[p]], digests[index[p]]
                    keeper = known.get(d, False)
                    stay[at[p]] = not (keeper is not False and keeper is not None and ids[i] != keeper or listed[i] and d in lists[i])
                kept = flat.filter(pa.array(stay))
                n = np.diff(offsets)
                left = np.bincount(of[stay], minlength=len(ids))
                upto = pa.array(np.concatenate(([0], np.cumsum(left))), pa.int32())
                text = pc.binary_join(pa.ListArray.from_arrays(upto, kept), pa.scalar("\n", pa.large_string())).cast(pa.string())
                text = pc.if_else(pc.is_valid(part.column(name)), text, pa.scalar(None, pa.string()))
                out = part.set_column(part.schema.get_field_index(name), name, text)
                if own:
                    out = out.drop_columns([own])
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(n), pa.array(n - left)], names=[*out.schema.names, "n_lines", "n_dropped"])

    return run


@tidy
def drop_repeated_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, folded: int = FOLDED, held: int = HELD) -> DataFrame:
    """docs (doc_id, text and any others) without repeated lines; adds n_lines, before, and n_dropped.

    A line's key is the line stripped of blanks, A-Z in lower case.  Keys of at least least_chars code
    points that stand in at least least_docs rows lose their lines everywhere but in the
    rows of the largest doc_id that holds them.  A null text is one empty line and stays null; a null
    doc_id comes before all others, and if all rows with a line lack one it stays in all.
    Columns n_lines and n_dropped of docs are replaced; an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*rest)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    bits = sc.broadcast(seen_twice(own, least_chars, cells_for(own, least_chars), folded))
    found = cut(repeated_lines(own, bits, least_chars, least_docs), "lines")
    n, total = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    often = found.where(F.col("n") > total / held) if n > held else found  # held of them at most
    kept = often.select("digest", "keeper").toArrow()
    keepers = sc.broadcast(dict(zip(kept.column("digest").to_pylist(), kept.column("keeper").to_pylist(), strict=True)))
    id_, drops = free_name("_id", rest), None
    ready = docs.select(*rest, F.col("doc_id").cast("bigint").alias(id_))
    if n > held:
        lists = _own_drops(own, found.where(F.col("n") <= total / held).select("digest", "keeper"), bits, least_chars).alias("g")
        drops = free_name("_drops", [*rest, id_])
        d = ready.alias("d")
        ready = d.join(lists, F.col(f"d.`{id_}`").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.sig")), "left").select("d.*", F.col("g.drops").alias(drops))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name != drops)
    out = ready.mapInArrow(_without("text", drops, keepers, least_chars, id_), f"{kinds}, n_lines bigint, n_dropped bigint")
    return out.drop(id_)
