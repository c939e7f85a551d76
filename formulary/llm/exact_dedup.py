"""Exact deduplication by a log-structured merge index.

Each task owns a memtable: digest -> the rows seen, with the text of the first
one. A row whose digest is there is a hit; its bytes are compared with the kept
text before it joins, so rows that merely share a digest stay apart. A full
memtable is flushed as a run: one entry per text, sorted by digest, with the
member ids. Runs are written to the shared folder as Parquet with Bloom filters
on the digest. Compaction merges the runs by digest and keeps one identifier per
text, the smallest or the largest. Digests that more than one run holds are
hits between runs: the representatives' bytes are compared with those of the
compacted entry, and an entry that differs gets a place of its own.

What crosses the network is a digest and ids, never the texts, but for the
representatives of hits between runs. A digest that a third of all rows share
has one entry per run; what compaction finds of digests with more than HOT rows is
broadcast (one row in HOT at most), so that their members stay where they are.

Defined results: null counts as the empty text; empty texts are equal to one
another; rows that repeat an id keep their own row, with the same keep_id; rows
without an id count, but another's id is kept where there is one: among equal
texts that all have none, keep_id is null and all are kept; an empty table gives an
empty result; other columns of the input are ignored. ``without_copies`` goes by
rows: of rows that repeat both id and text one stays, and a row that has but its id
in common with a dropped one stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulary.llm.storage import few, fresh_path, lean, without_rows, written

#: Text bytes that a memtable holds before it is flushed.
MEMTABLE_BYTES = 24 << 20
#: Rows that a memtable holds before it is flushed.
MEMTABLE_ROWS = 200_000
#: Rows of a text from which its members do not move.
HOT = 20_000

RUNS = pa.schema([("digest", pa.binary()), ("rep", pa.int64()), ("keep", pa.int64()), ("members", pa.list_(pa.int64()))])
RUNS_DDL = "digest binary, rep bigint, keep bigint, members array<bigint>"


class Memtable:
    """Digest -> [(text, ids)], one item for each different text of that digest."""

    def __init__(self, keep: Callable, digest_bytes: int):
        self.keep, self.digest_bytes = keep, digest_bytes
        self.clear()

    def clear(self) -> None:
        self.held: dict[bytes, list[tuple[bytes, list[int]]]] = {}
        self.bytes = self.rows = 0

    def add(self, row: int, text: bytes) -> None:
        entries = self.held.setdefault(digest(text, self.digest_bytes), [])
        self.rows += 1
        for kept, ids in entries:
            if kept == text:  # byte verification of the hit
                ids.append(row)
                return
        entries.append((text, [row]))
        self.bytes += len(text)

    def full(self) -> bool:
        return self.bytes >= MEMTABLE_BYTES or self.rows >= MEMTABLE_ROWS

    def flush(self) -> pa.RecordBatch:
        entries = [(d, ids) for d in sorted(self.held) for _, ids in self.held[d]]
        self.clear()
        columns = [[d for d, _ in entries], [ids[0] for _, ids in entries], [self.keep(ids) for _, ids in entries], [ids for _, ids in entries]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RUNS, strict=True)], schema=RUNS)


def digest(text: bytes, size: int) -> bytes:
    return hashlib.sha256(text).digest()[:size]


def normal(column: pa.Array) -> Iterator[bytes]:
    """Texts in UTF-8 with A-Z lower-cased; null is empty."""
    for x in column.cast(pa.binary()):
        yield (x.as_py() or b"").lower()  # of bytes, lower() changes A-Z alone


def runs(docs: DataFrame, keep: str, digest_bytes: int) -> DataFrame:
    """One entry for each text and flushed memtable, sorted by digest within its run."""
    best = {"smallest": min, "largest": max}[keep]

    def choose(ids: list[int | None]) -> int | None:
        return best((x for x in ids if x is not None), default=None)

    def flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memtable = Memtable(choose, digest_bytes)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), normal(batch.column(1)), strict=True):
                memtable.add(row, text)
                if memtable.full():
                    yield memtable.flush()
        if memtable.rows:
            yield memtable.flush()

    return docs.mapInArrow(lean(flushes), RUNS_DDL)


def digested(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """rep, digest and normalised text of each row."""

    def lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(normal(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(x, digest_bytes) for x in texts], pa.binary()), pa.array(texts, pa.binary())], ["rep", "digest", "text"])

    return docs.mapInArrow(lean(lowered), "rep bigint, digest binary, text binary")


def dedup(docs: DataFrame, keep: str = "smallest", digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest for every row of (doc_id, text).

    ``keep`` says which identifier of equal texts stays. ``digest_bytes`` shortens
    the digest, so that tests can make different texts meet in one.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    spark = docs.sparkSession
    path = fresh_path(spark, "lsm-runs")
    runs(docs, keep, digest_bytes).write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled#digest", "true").parquet(path)
    entries = spark.read.schema(RUNS_DDL).parquet(path)

    # Hits between runs: digests of more than one entry. Each representative is held against the first.
    several = entries.groupBy("digest").agg(F.count("*").alias("n"), F.min("rep").alias("first_rep")).where("n > 1").drop("n")
    hits = written(entries.select("digest", "rep").join(several, "digest"), "lsm-hits")
    ids = hits.select(F.col("rep").alias("doc_id")).distinct()  # holds the first ones too
    texts = digested(docs.join(F.broadcast(ids) if few(hits) else ids, "doc_id", "left_semi"), digest_bytes)
    texts = texts.join(hits.select("digest", "rep").distinct(), ["digest", "rep"], "left_semi").groupBy("digest", "rep").agg(F.min("text").alias("text"))
    first = hits.select("digest", F.col("first_rep").alias("rep")).distinct().join(texts, ["digest", "rep"]).select("digest", F.col("text").alias("first_text"))
    differs = written(texts.join(first, "digest").where("text <> first_text").select("digest", "rep", F.hex("text").alias("place")), "lsm-apart")
    if differs.isEmpty():
        placed = entries.withColumn("place", F.lit(""))
    else:
        placed = entries.join(differs, ["digest", "rep"], "left").withColumn("place", F.coalesce("place", F.lit("")))

    # Compaction: one identifier for each digest and text; then every member learns of it.
    best = F.min("keep") if keep == "smallest" else F.max("keep")
    compacted = placed.groupBy("digest", "place").agg(best.alias("keep_id"), F.sum(F.size("members")).cast("bigint").alias("group_size"))
    compacted = written(compacted, "lsm-compacted")
    members, hot = placed.select("digest", "place", "members"), compacted.where(F.col("group_size") > HOT)
    if few(hot):  # one row in HOT at most
        rows = members.join(F.broadcast(hot), ["digest", "place"]).unionByName(members.join(F.broadcast(hot.select("digest", "place")), ["digest", "place"], "left_anti").join(compacted.where(F.col("group_size") <= HOT), ["digest", "place"]))
    else:
        rows = members.join(compacted, ["digest", "place"])
    rows = rows.select(F.explode("members").alias("doc_id"), "keep_id", "group_size", "digest")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def without_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs``, all columns, one for each text."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.unhex(F.sha2(F.encode(F.translate(F.coalesce("text", F.lit("")), upper, lower), "UTF-8"), 256))
    key = lambda x: F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), x.alias("digest"))
    found = written(dedup(docs, keep).select(key(F.col("digest")).alias("key"), "kept"), "lsm-rows")
    gone = written(found.where("not kept").select("key").distinct(), "lsm-dropped")
    repeated = written(found.where("kept").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "lsm-repeated")
    return without_rows(docs, gone, repeated, key(text))
