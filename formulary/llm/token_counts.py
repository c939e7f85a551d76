"""Token counts of documents in flat token files, by a scan for separators.

A token file is a run of little-endian integers, documents one after another, each
closed by the end-of-document identifier, with no index. Files are read in blocks
that know nothing of documents. A block's task compares all its tokens with the
separator at once and reports the tokens before its first separator, those behind
its last one, and the lengths between. A prefix scan over the blocks of a file
then says which document a block begins in and how many of its tokens came before;
so a document may span any number of blocks.

``write`` makes such files from texts with a public byte-pair vocabulary. A file
counts only if its task's rows came back, so that a task that is run again after a
lost executor leaves nothing wrong behind. Which document stands where in a file is
kept in a table, in order.

Defined results: null and empty texts have 0 tokens; tokens behind a file's last
separator are a document of their own; an empty file has no documents; rows that
repeat an id are counted each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formulary.llm.storage import fresh_path, written

#: A public byte-level vocabulary for many languages, as ranks; its next free identifier is the separator.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How texts are cut before merging; goes with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_BYTES = 8 << 20
FILE_BYTES = 512 << 20
#: Tasks that scan, at most.
MOST_TASKS = 20_000

_encoders: dict[str, object] = {}


def encoder(path: str, data: bytes | None = None):
    """The encoder of a vocabulary; on executors, of its bytes as the driver has sent them."""
    if path not in _encoders:
        import tiktoken

        lines = (data if data is not None else Path(path).read_bytes()).splitlines()
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def separator(path: str) -> int:
    """The first identifier that the vocabulary leaves free."""
    return encoder(path).max_token_value + 1


def opened(uri: str, mode: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return store.open_input_file(path)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Flat token files in a folder; file, start (documents of the file before), ids of a stretch of documents, tokens in it."""

    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # the vocabulary, about a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary, sent.value).encode_ordinary, separator(vocabulary)
        kind = np.dtype("<u2" if end < 1 << 16 else "<u4")
        out = name = None
        start = size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name, start, size = f"{uuid.uuid4().hex}.bin", 0, 0
                out = opened(f"{folder}/{name}", "w")
            tokens = 0
            for text in batch.column(1):
                ids = np.array([*encode(text.as_py() or ""), end], dtype=kind)
                out.write(ids.tobytes())
                tokens += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([start], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([tokens], pa.int64())], ["file", "start", "ids", "tokens"])
            start, size = start + batch.num_rows, size + tokens * kind.itemsize
            if size >= FILE_BYTES:
                out.close()
                out = None
        if out is not None:
            out.close()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "file string, start bigint, ids array<bigint>, tokens bigint")


def scanned(files: DataFrame, folder: str, end: int, item: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, size, separators, head, tail, inner of every block of (file, tokens); all counted in tokens."""
    width = max(1, block_bytes // item)
    count = F.ceil(F.col("tokens") / width).cast("int")
    number = files.agg(F.sum(count)).first()[0] or 0
    # A row stands for a whole block, so rows of a few bytes must not be put together in one task.
    blocks = files.where("tokens > 0").select("file", "tokens", F.explode(F.sequence(F.lit(0), count - 1)).alias("block")).repartition(max(1, min(number, MOST_TASKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, tokens, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = block * width
                with opened(f"{folder}/{name}", "r") as source:
                    held = np.frombuffer(source.read_at(min(width, tokens - first) * item, first * item), dtype=f"<u{item}")
                at = np.flatnonzero(held == end)
                head, tail = (int(at[0]), len(held) - int(at[-1]) - 1) if len(at) else (len(held), 0)
                inner = np.diff(at) - 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.int64()) for x in (block, len(held), len(at), head, tail)), pa.array([inner], pa.list_(pa.int64()))], ["file", "block", "size", "separators", "head", "tail", "inner"])

    return blocks.mapInArrow(run, "file string, block bigint, size bigint, separators bigint, head bigint, tail bigint, inner array<bigint>")


def stitched(blocks: DataFrame) -> DataFrame:
    """file, place (of a document in its file, from 0), n_tokens."""
    file = W.partitionBy("file").orderBy("block")
    upto = file.rowsBetween(W.unboundedPreceding, 0)
    # Blocks since the last separator hand on what they hold behind it.
    since = F.sum((F.col("separators") > 0).cast("int")).over(upto)
    told = blocks.withColumn("since", since).withColumn("open", F.sum(F.when(F.col("separators") > 0, F.col("tail")).otherwise(F.col("size"))).over(W.partitionBy("file", "since").orderBy("block").rowsBetween(W.unboundedPreceding, 0)))
    told = told.withColumn("carried", F.coalesce(F.lag("open").over(file), F.lit(0))).withColumn("before", F.sum("separators").over(upto) - F.col("separators")).withColumn("last", F.lead("block").over(file).isNull())
    closed = F.when(F.col("separators") > 0, F.concat(F.array(F.col("carried") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(F.col("last") & (F.col("open") > 0), F.array("open")).otherwise(F.array().cast("array<bigint>"))
    return told.select("file", "before", F.posexplode(F.concat(closed, rest)).alias("i", "n_tokens")).select("file", (F.col("before") + F.col("i")).alias("place"), "n_tokens")


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens of every row of (doc_id, text), by way of flat token files."""
    folder = fresh_path(docs.sparkSession, "tokens")
    stretches = written(write(docs, folder, vocabulary), "token-files")
    end = separator(vocabulary)
    files = stretches.groupBy("file").agg(F.sum("tokens").alias("tokens"))
    counts = stitched(scanned(files, folder, end, 2 if end < 1 << 16 else 4, block_bytes))
    ids = stretches.select("file", "start", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("start") + F.col("i")).alias("place"), "doc_id")
    # The file of ids is small beside its rows, so its size would mislead Spark into a broadcast.
    return ids.hint("merge").join(counts, ["file", "place"]).select("doc_id", "n_tokens")
