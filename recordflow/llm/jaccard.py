"""N-gram Jaccard join by parity sketches.

Documents link when their sets of word shingles have a Jaccard similarity of at
least ``percent``/100.  The sketch of a set is a bit string into which every
shingle XORs one bit: the Hamming distance of two sketches never exceeds the
symmetric difference of the sets.  It is stored sparsely: K chunks, each one the
XOR of the mixed positions of its odd bits.

* Sizes fall into bands.  A pair meets in the band of its larger set, where
  K is fixed, so a set is sketched for its own band and, if a partner there is
  possible, for the next.
* d bounds the symmetric difference of a set and any partner.  At most d chunks
  differ; so of the filled chunks of two partners all but d are equal and, by any
  order of chunks that their content decides, the first d + 1 of each hold one
  that both have (pigeonhole).  A small set may fill no more than d chunks: it is
  also found by its d + 1 smallest shingles, of which its partners of that kind
  have one.  The order takes chunks with many uncommon shingles first; which are
  common comes from a counter array of fixed size that is summed over all documents.
* Equal sets are collapsed first: a class is one row with its smallest id.
* Classes that share a chunk are tied to the smallest id with that chunk; the
  components of these ties (families) hold every linked pair.  A family is
  compared in blocks: Hamming distance of dense sketches, then exact sets, for
  pairs that no link found so far connects.  A block returns a forest, not its
  pairs.  No bucket, family or partner count is capped.
* Lines and passages that many documents hold join unrelated ones to a family, the
  larger the more documents there are.  So the members of families of
  WIDE blocks and more are tied once more, by their rarest shingles as counted among them: partners
  share one of the first n - ceil(n * percent / 100) + 1 in any common order, and a set with as many
  shingles of its own has no partner.  What is compared in blocks are the components of these ties.
* The forest is the shortcut of jaccard_components.  jaccard_join checks every
  candidate pair of a block and returns all links between classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .store import cut, drop, large, small, summed, tidy

#: Bits of a dense sketch; a multiple of 64.
DENSE = 2048
#: Members of a block and bytes of their sets, about; a family of b blocks is compared in b^2 / 2 tasks' worth of pairs.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Families of so many blocks are parted first; fewer blocks are dealt out for less than their shingles' counts cost.
WIDE = 4
#: log2 of the number of shared counters for shingle frequency.
COUNTER_BITS = 18
#: A class of shingles is common from so many times the mean on.
COMMON = 3.0
#: Sizes of a band differ by this factor at most.
BAND = 3.0


def common_classes(docs: DataFrame, k: int) -> np.ndarray:
    """Which of 2^COUNTER_BITS classes of shingle hashes hold far more shingles than the mean class.

    Its size does not depend on the corpus, and each partial sum is as large.
    """
    slots = 1 << COUNTER_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for part in W.slices(batch):
                flat, offsets = W.split(W.texts(part), lower=True)
                s, _ = W.shingles(W.word_hashes(flat), offsets, k)
                total += np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        return total

    total = summed(docs.select("text"), count, slots)
    return total > COMMON * max(1.0, total.mean())


def _bands(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, number of chunks) of a set of n: of its own size, and of its largest possible partner's."""
    out = []
    for size in {_band(n), _band(n * 100 // percent)}:
        upper = int(BAND ** (size + 1))
        out.append((size, _allowed(upper, upper, percent) + 1 + max(1, upper // 11)))
    return sorted(out)


def _band(n: int) -> int:
    b = 0
    while BAND ** (b + 1) <= n:
        b += 1
    return b


def _allowed(a, b, percent: int):
    """Largest symmetric difference of linked sets with these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def _keys(s: np.ndarray, n: int, percent: int, common: np.ndarray) -> np.ndarray:
    """The chunks, and for small sets shingles, by which a set is found: in each band the first d + 1 in the order that content decides."""
    out = []
    uncommon = ~common[(s & np.uint64((1 << COUNTER_BITS) - 1)).astype(np.int64)]
    high = s >> np.uint64(32)
    for band, chunks in _bands(n, percent):
        upper = int(BAND ** (band + 1))
        largest = min(upper, n * 100 // percent)
        take = _allowed(n, max(n, largest), percent) + 1
        chunk = ((high * np.uint64(chunks)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(chunk, kind="stable")
        filled, start = np.unique(chunk[order], return_index=True)
        parity = np.bitwise_xor.reduceat(W.mix(s[order], 7), start)
        rare = np.minimum(np.add.reduceat(uncommon[order].astype(np.int64), start), 255).astype(np.uint64)
        key = W.mix(parity ^ W.mix(filled.astype(np.uint64), 1000 + band))
        first = ((np.uint64(255) - rare) << np.uint64(48)) | (key >> np.uint64(16))
        out.append(key[np.argsort(first, kind="stable")[:take]])
        if len(filled) < take:  # perhaps no filled chunk is equal: the smallest shingles are
            out.append(W.mix(np.sort(W.mix(s, 9))[:take], 2000 + band))
    return np.concatenate(out).astype(np.int64)


def _sets(part: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    flat, offsets = W.split(W.texts(part), lower=True)
    s, at = W.shingles(W.word_hashes(flat), offsets, k)
    for d in range(part.num_rows):
        yield np.unique(s[at[d] : at[d + 1]])


def class_table(docs: DataFrame, k: int, percent: int, common) -> DataFrame:
    """doc_id, n (set size), sig (128-bit hash of the set; null if empty), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value
        for batch in batches:
            for part in W.slices(batch):
                n, sig, keys, at = [], [], [], [0]
                for s in _sets(part, k):
                    n.append(len(s))
                    sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if len(s):
                        keys.append(_keys(s, len(s), percent, table))
                    at.append(at[-1] + (len(keys[-1]) if len(s) else 0))
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), lists], names=["doc_id", "n", "sig", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, sig binary, keys array<bigint>")


def _dense(s: np.ndarray) -> bytes:
    bits = np.bincount((s >> np.uint64(8) & np.uint64(DENSE - 1)).astype(np.int64), minlength=DENSE) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def member_table(candidates: DataFrame, k: int) -> DataFrame:
    """family, blocks, doc_id, text -> family, blocks, doc_id, sketch, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                sets = list(_sets(part, k))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("family", "blocks", "doc_id")), pa.array([_dense(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["family", "blocks", "doc_id", "sketch", "set"])

    return candidates.select("family", "blocks", "doc_id", "text").mapInArrow(run, "family bigint, blocks bigint, doc_id bigint, sketch binary, set binary")


def _pairs(sketch: np.ndarray, sets: list[np.ndarray], side: np.ndarray, two: bool, percent: int, every: bool) -> list[tuple[int, int, int]]:
    """(i, j, common shingles) of the links within a block, or between two (side 0 and 1): every one, or a spanning forest."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    n = np.array([len(s) for s in sets])
    for i in range(len(sets)):
        others = np.flatnonzero(side > side[i]) if two else np.arange(i + 1, len(sets))
        others = others[np.minimum(n[others], n[i]) * 100 >= percent * np.maximum(n[others], n[i])]
        if not len(others):
            continue
        apart = np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1)
        for j in others[apart <= _allowed(n[others], n[i], percent)]:
            a, b = find(i), find(int(j))
            if a == b and not every:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (n[i] + n[j] - common):
                parent[max(a, b)] = min(a, b)
                out.append((i, int(j), common))
    return out


def block_links(members: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Links from members dealt out to pairs of blocks.

    (a, b), ids whose components are those of all links; or every link as
    (a, b, n_a, n_b, n_common), a and b the hashes of the sets, a < b.
    """
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    dealt = members.withColumn("own", mine).withColumn(
        "pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j"))))
    ).select("family", "pair.i", "pair.j", (F.col("own") == F.col("pair.j")).cast("int").alias("side"), "doc_id", "sketch", "set")
    dealt = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list[tuple]) -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            ids = np.array([r[4] for r in rows], np.int64)
            sketch = np.frombuffer(b"".join(r[5] for r in rows), np.uint64).reshape(len(rows), -1)
            sets = [np.frombuffer(r[6], np.uint64) for r in rows]
            links = _pairs(sketch, sets, np.array([r[3] for r in rows]), rows[0][1] != rows[0][2], percent, every)
            if not every:
                return pa.RecordBatch.from_arrays([pa.array([int(ids[x[c]]) for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"]) if links else None
            sig = [hashlib.blake2b(r[6], digest_size=16).digest() for r in rows]
            found = [(sig[i], sig[j], len(sets[i]), len(sets[j]), common) if sig[i] < sig[j] else (sig[j], sig[i], len(sets[j]), len(sets[i]), common) for i, j, common in links if sig[i] != sig[j]]
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.binary() if c < 2 else pa.int64()) for c in range(5)], names=["a", "b", "n_a", "n_b", "n_common"]) if found else None

        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
                if rows and row[:3] != rows[0][:3]:
                    if (out := close(rows)) is not None:
                        yield out
                    rows = []
                rows.append(row)
        if (out := close(rows)) is not None:
            yield out

    return dealt.mapInArrow(run, "a binary, b binary, n_a bigint, n_b bigint, n_common bigint" if every else "a bigint, b bigint")


def shared_chunks(heads: DataFrame) -> DataFrame:
    """head, keys -> ties (a, b): every head to the smallest head with the same key.

    Equal keys of one batch are tied there and sent on once, so a key that many
    heads share reaches its task as a row for each batch of heads.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            key = lists.flatten().to_numpy()
            head = np.repeat(batch.column("head").to_numpy(), np.diff(np.asarray(lists.offsets)))
            order = np.lexsort((head, key))
            key, head = key[order], head[order]
            new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            lead = head[new][np.cumsum(new) - 1] if len(key) else head
            local = ~new & (head != lead)
            tied = np.unique(np.stack([head[local], lead[local]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key[new], W.mix(tied[:, 0].astype(np.uint64), 5).astype(np.int64)])), pa.array(np.concatenate([head[new], tied[:, 0]])), pa.array(np.concatenate([np.full(int(new.sum()), -1), tied[:, 1]]), mask=np.concatenate([np.ones(int(new.sum()), bool), np.zeros(len(tied), bool)]))],
                names=["key", "head", "lead"],
            )

    rows = heads.select("head", "keys").mapInArrow(combine, "key bigint, head bigint, lead bigint")
    least = F.min(F.when(F.col("lead").isNull(), F.col("head"))).over(Window.partitionBy("key"))
    return rows.select("head", F.coalesce("lead", least).alias("lead")).where("head <> lead").select(F.col("head").alias("a"), F.col("lead").alias("b")).distinct()


def _rarest(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """head, n (set size), keys of each set of docs (doc_id, text): those of its rarest shingles by which a partner finds it, none that it has alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                sets = list(_sets(part, k))
                n = np.array([len(s) for s in sets], np.int64)
                mark = np.array([int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets], np.int64)
                head = part.column("doc_id").to_numpy()
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(x, n)) for x in (head, mark, n)), pa.array(np.concatenate(sets).view(np.int64))], names=["head", "mark", "n", "shingle"])

    rows = cut(docs.select("doc_id", "text").mapInArrow(run, "head bigint, mark bigint, n bigint, shingle bigint"), "shingles")
    often = rows.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    # by rising count, then by hash
    key = F.shiftleft(F.least("times", F.lit((1 << 15) - 1)), 48).bitwiseOR(F.shiftrightunsigned("shingle", 16))
    shared = rows.join(large(often), "shingle").groupBy("head", "mark").agg(F.max("n").alias("n"), F.collect_list("shingle").alias("shared"), F.collect_list(key).alias("keys"))
    alone = F.col("n") - F.size(F.array_distinct("shared"))
    take = (F.floor(F.col("n") * (100 - percent) / 100) + 1 - alone).cast("int")
    return shared.select("head", "n", F.slice(F.array_sort(F.array_distinct("keys")), F.lit(1), F.greatest(take, F.lit(0))).alias("keys"))


def _blocks(sized: DataFrame) -> DataFrame:
    """doc_id, family, n -> doc_id, family, blocks."""
    size = sized.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("long").alias("blocks"))
    return cut(sized.join(small(cut(size, "blocks")), "family").select("doc_id", "family", "blocks"), "members")


def _parted(docs: DataFrame, known: DataFrame, k: int, percent: int) -> DataFrame:
    """known (doc_id, family, blocks) with the families of WIDE blocks and more parted by ties of rare shingles; members without a tie are left out."""
    wide = known.where(F.col("blocks") >= WIDE)
    if wide.isEmpty():
        return known
    heads = cut(_rarest(docs.join(small(wide.select("doc_id")), "doc_id"), k, percent), "rarest")
    ties = cut(shared_chunks(heads.where(F.size("keys") > 0)), "ties")
    families = components(ties, "families").select(F.col("id").alias("doc_id"), F.col("root").alias("family"))
    sizes = heads.groupBy(F.col("head").alias("doc_id")).agg(F.max("n").alias("n"), F.count("*").alias("sets"))
    # sets of one doc_id stay together
    sized = sizes.join(small(families), "doc_id", "left").where("family is not null or sets > 1")
    parted = _blocks(cut(sized.select("doc_id", F.coalesce("family", "doc_id").alias("family"), "n"), "sized"))
    drop(heads)
    drop(ties)
    return cut(known.where(F.col("blocks") < WIDE).union(parted), "members")


def _candidates(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """classes (doc_id, n, sig) of every row, and the family members that may link (family, blocks, doc_id, sketch, set)."""
    common = docs.sparkSession.sparkContext.broadcast(common_classes(docs, k))
    table = cut(class_table(docs, k, percent, common), "classes")
    held = table.where("sig is not null and doc_id is not null")
    heads = held.groupBy("sig").agg(F.min_by("keys", "doc_id").alias("keys"), F.min("doc_id").alias("head"))
    ties = cut(shared_chunks(heads), "ties")
    classes = cut(table.select("doc_id", "n", "sig"), "classes")
    held = classes.where("sig is not null and doc_id is not null")
    drop(table)
    families = components(ties, "families")
    sized = families.join(small(held.join(small(families.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("n").alias("n"))), families.id == F.col("doc_id"))
    sized = cut(sized.select("doc_id", F.col("root").alias("family"), "n"), "sized")
    known = _blocks(sized)
    drop(ties)
    drop(sized)
    known = _parted(docs, known, k, percent)
    return classes, member_table(docs.join(small(known), "doc_id"), k)


@tidy
def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Nulls, empty texts and texts without a word have no shingle and are their own
    component; texts of fewer than k words have one, their whole sequence.  Rows
    with the same doc_id count as one node of the graph and give a row each.  A
    row without a doc_id links with nothing and has a null component.  Other
    columns of docs are ignored.  An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes, members = _candidates(docs, k, percent)
    held = classes.where("sig is not null and doc_id is not null")
    heads = held.groupBy("sig").agg(F.min("doc_id").alias("head"))
    links = cut(block_links(members, percent), "links")
    if _repeats(held):  # a doc_id with several texts ties their classes together
        links = links.union(held.join(heads, "sig").select("doc_id", "head"))
    roots = components(links, "roots")
    named = heads.join(roots.withColumnRenamed("id", "head"), "head", "left").select("sig", F.coalesce("root", "head").alias("root"))
    return classes.join(named, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


@tidy
def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(links, members): every pair of different sets that links, and which rows have which set.

    links: a, b, n_a, n_b, n_common, once for each pair of classes, verified on the
    sets themselves.  members: doc_id, n_shingles, sig for every row of docs; sig is
    null without a shingle.  Rows of one sig link with each other too.  Rows without a
    doc_id stand in no link.  The number of links grows with the square of a group
    of near copies, as the join's result does; exact copies add none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes, members = _candidates(docs, k, percent)
    links = block_links(members, percent, every=True)
    if _repeats(classes.where("sig is not null and doc_id is not null")):  # a class may stand in several families then
        links = links.distinct()
    return cut(links, "links"), classes.select("doc_id", F.col("n").alias("n_shingles"), "sig")


@tidy
def link_counts(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, n_links for every row of docs: how many other rows with a doc_id it links with, equal ones included."""
    links, members = jaccard_join(docs, k, percent)
    sizes = members.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.count("*").alias("size"))
    both = links.select(F.col("a").alias("own"), F.col("b").alias("sig")).union(links.select(F.col("b").alias("own"), F.col("a").alias("sig")))
    others = both.join(sizes, "sig").groupBy("own").agg(F.sum("size").alias("near")).withColumnRenamed("own", "sig")
    total = sizes.join(others, "sig", "left").select("sig", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("found"))
    return members.join(total, "sig", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("found", F.lit(0))).cast("long").alias("n_links"))


def _repeats(held: DataFrame) -> bool:
    """Whether some doc_id stands in several rows."""
    return bool(held.groupBy("doc_id").count().where("count > 1").limit(1).count())


@tidy
def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, all columns unchanged.

    Rows of that doc_id with different texts stay, of equal ones one stays.  Null and
    empty texts, and texts without a word, link with nothing and stay; so does every row
    without a doc_id.  An empty table gives no rows.
    """
    own = jaccard_components(docs, k, percent).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null")
    kept = named.join(own, named.doc_id.cast("long") == own.doc_id, "left_semi")
    return (kept.dropDuplicates(["doc_id", "text"]) if _repeats(named) else kept).union(docs.where("doc_id is null"))
