"""Benchmark decontamination by spaced seeds.

Words are lower-cased. A window is SPAN words. Two fixed masks look at every other
word of a window, one at the odd and one at the even places, so that any one
substituted word is ignored by one of them: no window with at most one
substitution is missed. Hashes of the masked windows of the benchmark and of the
documents are joined; every hit is an alignment of an item with a document, and
the words of the two are then compared along it. A document overlaps an item if
some window of SPAN words of the item stands in the document, in order, with at
most one word substituted. Items of fewer words than SPAN are looked for whole
and unchanged.

The benchmark's hashes are broadcast only if their number, which is counted, is
within a bound; else both sides are shuffled by hash. Documents' texts are never
shuffled unless the hits are too many to be broadcast by id. Only DataFrame
functions are used.

Defined results: null and empty texts overlap with nothing, as do items without
words; repeated rows have the same overlaps, once; of rows that repeat an id, the
most is told; documents without an id cannot be named, so ``overlaps`` leaves them
out; ``clean`` goes by rows, whatever their ids; an empty table on either side gives no overlaps; other columns
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulary.llm.storage import BROADCAST_ROWS, few, row_id, without_rows, written

SPAN = 12
#: Bytes of items that may be broadcast.
ITEM_BYTES = 32 << 20
#: Words of a window that may be substituted.
TOLERATED = 1
#: Places of a window that each mask looks at.
MASKS = (tuple(range(0, SPAN, 2)), tuple(range(1, SPAN, 2)))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def seeds(hashed: Column, mask: tuple[int, ...], span: int, label: int) -> Column:
    """Hash of what the mask sees of each window of an array of word hashes."""
    last = F.size(hashed) - span
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(label), *[F.get(hashed, i + k) for k in mask]))


def masked(hashed: Column, spans: list[int]) -> list[tuple[int, Column]]:
    """(span, seeds) of every mask: the two of SPAN, and whole ones of the shorter spans."""
    out = [(SPAN, seeds(hashed, mask, SPAN, i)) for i, mask in enumerate(MASKS)]
    return out + [(n, seeds(hashed, tuple(range(n)), n, 100 + n)) for n in spans]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and the most words that an alignment of the two has in common."""
    docs = docs.where("doc_id IS NOT NULL")
    named = row_overlaps(docs, benchmark)
    rows = docs.select("doc_id", row_id("doc_id", "text").alias("rid"))
    ids = written(named.select("rid", "item_id", "overlap"), "leaks-by-row")
    return rows.join(F.broadcast(ids) if few(ids) else ids, "rid").groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"))


def row_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """rid, item_id and overlap, with row_id(doc_id, text) in place of the id."""
    docs = docs.select(row_id("doc_id", "text").alias("rid"), "text")
    items = written(benchmark.select("item_id", tokens(F.col("text")).alias("item")).where(F.size("item") > 0).distinct(), "leak-items")
    short = sorted(r[0] for r in items.where(F.size("item") < SPAN).select(F.size("item")).distinct().collect())  # at most SPAN - 1 numbers
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))

    known = items.withColumn("h", hashed(F.col("item")))
    parts = []
    for span, found in masked(F.col("h"), short):
        fits = F.size("item") >= SPAN if span == SPAN else F.size("item") == span
        parts.append(known.where(fits).select("item_id", F.posexplode(found).alias("item_at", "seed"), F.lit(span).alias("span")))
    ours = parts[0]
    for part in parts[1:]:
        ours = ours.unionByName(part)
    ours = written(ours.distinct(), "leak-seeds")

    theirs = docs.select("rid", hashed(tokens(F.col("text"))).alias("h"))
    arrays = masked(F.col("h"), short)
    # One array of all seeds of a document; the place within it tells mask and position.
    theirs = theirs.select("rid", F.size("h").alias("n"), F.posexplode(F.concat(*[a for _, a in arrays])).alias("place", "seed"))
    small = ours.count() <= BROADCAST_ROWS
    hits = theirs.join(F.broadcast(ours) if small else ours, "seed")
    number = lambda span: F.greatest(F.col("n") - span + 1, F.lit(0))
    start, at = F.lit(0), None
    for span, _ in arrays:
        inside = F.col("place") < start + number(span)
        at = F.when(inside, F.col("place") - start) if at is None else at.when(inside, F.col("place") - start)
        start = start + number(span)
    hits = written(hits.select("rid", "item_id", (at - F.col("item_at")).alias("shift")).distinct(), "leak-hits")

    ids = hits.select("rid").distinct()
    suspects = docs.join(F.broadcast(ids) if few(hits) else ids, "rid", "left_semi").select("rid", tokens(F.col("text")).alias("words"))
    narrow = (items.agg(F.sum(F.length(F.array_join("item", " ")) + 16 * F.size("item"))).first()[0] or 0) <= ITEM_BYTES
    pairs = suspects.join(hits, "rid").join(F.broadcast(items) if narrow else items, "item_id")
    length = F.size("item")
    same = F.transform(F.sequence(F.lit(0), length - 1), lambda k: F.coalesce(F.get(F.col("words"), F.col("shift") + k) == F.get(F.col("item"), k), F.lit(False)).cast("int"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, b: a + b)
    inside = lambda q, span: (F.col("shift") + q >= 0) & (F.col("shift") + q + span <= F.size("words"))
    windows = F.exists(F.sequence(F.lit(0), length - SPAN), lambda q: inside(q, SPAN) & (total(F.slice(F.col("same"), q + 1, SPAN)) >= SPAN - TOLERATED))
    holds = F.when(length >= SPAN, windows).otherwise(total(F.col("same")) == length)
    return pairs.withColumn("same", same).where(holds).groupBy("rid", "item_id").agg(F.max(total(F.col("same"))).cast("bigint").alias("overlap"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that overlap no item of the benchmark."""
    leaks = written(row_overlaps(docs, benchmark).select(F.col("rid").alias("key")).distinct(), "leaks")
    return without_rows(docs, leaks, leaks.where("false"), row_id("doc_id", "text"))
