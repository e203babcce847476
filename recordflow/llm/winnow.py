"""Document fingerprints by winnowing, in DataFrame functions only.

The hash of k words is a rolling one, the cyclic polynomial: the XOR of the words'
hashes, each rotated by the number of words after it.  Rolling by b words is a
rotation by b, so runs of 1, 2, 4, ... words are put together to k.  Of every window
of w consecutive hashes the smallest is kept, all 64 bits compared, the rightmost of
equal ones, with its position: places of minima of 1, 2, 4, ... hashes are compared
to those of w.  Any w + k - 1 words that two documents share leave a common
fingerprint.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range of ids, about, and ranges at most (beyond them, ranges grow; their bounds and first rows are broadcast).
RANGE_ROWS, RANGES = 1000, 65_536


def _shifted(a: Column, b: Column, by: int, f) -> Column:
    """f of a[i] and b[i + by] wherever both are there."""
    n = F.greatest(F.least(F.size(a), F.size(b) - by), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(by + 1), n), f)


def _followed(by: int):
    """The hash of words followed by ``by`` more: that of the first, rotated by so many bits, XOR that of the others."""
    turn = by % 64
    rotated = lambda x: F.shiftleft(x, turn).bitwiseOR(F.shiftrightunsigned(x, 64 - turn)) if turn else x
    return lambda x, y: rotated(x).bitwiseXOR(y)


def _powers(n: int) -> list[int]:
    """The binary parts of n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = 5, w: int = 16) -> DataFrame:
    """Adds columns name (array of hashes) and name_at (array of word positions) for a string column.

    Null and empty texts, and texts without a word, have empty arrays; fewer than
    k words are one gram, fewer than w grams one window.
    """
    keep = [c for c in df.columns]
    own = f"_{name}_"
    out = df.withColumn(f"{own}h", F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda x: x != ""), lambda x: F.xxhash64(x)))
    # hashes of 1, 2, 4, ... words, then of their sum, k words
    size = 1
    while size * 2 <= k:
        half = F.col(f"{own}{size}" if size > 1 else f"{own}h")
        out = out.withColumn(f"{own}{size * 2}", _shifted(half, half, size, _followed(size)))
        size *= 2
    have, gram = 0, None
    for part in _powers(k):
        column = F.col(f"{own}{part}" if part > 1 else f"{own}h")
        if gram is None:
            gram = column
        else:
            out = out.withColumn(f"{own}g{have + part}", _shifted(gram, column, have, _followed(part)))
            gram = F.col(f"{own}g{have + part}")
        have += part
    short = (F.size(f"{own}h") > 0) & (F.size(f"{own}h") < k)
    out = out.withColumn(f"{own}g", F.when(short, F.array(F.xxhash64(F.array_join(F.transform(F.col(f"{own}h"), lambda x: x.cast("string")), " ")))).otherwise(gram))
    g = F.col(f"{own}g")
    out = out.withColumn(f"{own}p1", F.transform(g, lambda x, i: i))
    least, size = F.col(f"{own}p1"), 1
    while size < w:
        step = min(size, w - size)
        out = out.withColumn(f"{own}p{size + step}", _shifted(least, least, step, lambda x, y: F.when(F.get(g, y) <= F.get(g, x), y).otherwise(x)))
        least, size = F.col(f"{own}p{size + step}"), size + step
    few = (F.size(g) > 0) & (F.size(g) < w)
    last = F.size(g) - F.array_position(F.reverse(g), F.array_min(g)).cast("int")  # the rightmost place of the smallest hash
    out = out.withColumn(f"{name}_at", F.when(few, F.array(last)).otherwise(F.array_distinct(least)))
    return out.withColumn(name, F.transform(F.col(f"{name}_at"), lambda p: F.get(g, p))).select(*keep, name, f"{name}_at")


def shown(name: str) -> Column:
    """A fingerprint as text: position:hash, comma-joined."""
    return F.array_join(F.zip_with(f"{name}_at", name, lambda p, h: F.concat(p.cast("string"), F.lit(":"), F.hex(h))), ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of the hash sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column>: that column's value in the next row by ascending doc_id; after the last, the first.

    Rows of one doc_id are ordered by the hash of their text; a null doc_id comes
    first.  Ids are cut into ranges of about equal size; every range also gets the
    first row of the range after it, so each row finds its next one within a range.
    """
    keyed = docs.withColumn("_h", F.xxhash64("text"))
    n = int(min(RANGES, max(1, docs.count() // RANGE_ROWS)))
    bounds = [] if n == 1 else sorted(set(docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 8 * n))).first()[0] or []))
    known = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")  # one literal, however many
    steps = F.array(*(F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1))) if bounds else F.array()
    id_ = F.coalesce("doc_id", F.lit(-(2**63)))
    # how many bounds are below the id, by halving
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(known, at + step - 1) < id_, F.lit(False)), at + step).otherwise(at)) if bounds else F.lit(0)
    keyed = keyed.withColumn("_range", below)
    ids = docs.select("doc_id", F.xxhash64("text").alias("_h")).withColumn("_range", below)
    least = ids.groupBy("_range").agg(F.min(F.struct(id_.alias("i"), "_h")).alias("f")).orderBy("_range").collect()  # a row for each range
    if not least:
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    rows = json.dumps([{"_i": r.f.i, "_fh": r.f._h, "_to": least[k - 1]._range} for k, r in enumerate(least)])
    firsts = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<_i: bigint, _fh: bigint, _to: int>>")).alias("r")).select("r.*")
    ids = sorted({r.f.i for r in least})
    first = F.col("doc_id").isin(ids) | (F.col("doc_id").isNull() if ids[0] == -(2**63) else F.lit(False))  # goes down to the scan, before any fingerprint
    after = keyed.where(first).join(F.broadcast(firsts), (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("_i")) & (F.col("_h") == F.col("_fh"))).dropDuplicates(["_i", "_fh", "_to"])
    both = keyed.withColumn("_last", F.lit(0)).unionByName(after.withColumn("_range", F.col("_to")).withColumn("_last", F.lit(1)).drop("_i", "_fh", "_to"))
    order = Window.partitionBy("_range").orderBy("_last", F.col("doc_id").asc_nulls_first(), "_h")
    return both.select(*docs.columns, "_last", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where("_last = 0").drop("_last")


def compare_fingerprints(docs: DataFrame, k: int = 5, w: int = 16) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.  The edited text has its last floor(n_chars / 2) code points
    replaced by the first as many (or all) of the next document by ascending
    doc_id.  A null text counts as empty.  Repeated rows give a row each; other
    columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(with_fingerprint(own, "text", "fp", k, w), ["text", "fp"])
    edited = both.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.concat(F.expr("left(text, cast(n_chars as int) - cast(n_chars div 2 as int))"), F.expr("left(next_text, cast(n_chars div 2 as int))"))).drop("text", "next_text")
    done = with_fingerprint(edited, "edited", "efp", k, w)
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown("fp").alias("fingerprint"),
        shown("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
