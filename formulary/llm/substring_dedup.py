"""Removal of word sequences that occur more than once, by FM-indexes.

A window is ``window`` consecutive words of one document. Every word covered by a
window whose words also start anywhere else is removed.

1. Each window is keyed by the least hash of the GRAM-word sequences in it, so that
   equal windows have equal keys, and neighbouring windows mostly share theirs: a
   run of windows with one key is a segment. Keys are counted over the corpus,
   combined within each task first. A key that occurs once has no repeated window.
2. Documents that hold repeated keys give their segments, as words, to shards by
   key. Equal segments of a task are one row. A key with more than HOT segments
   gives its windows one by one instead, by the hash of the whole window, so that
   what surrounds a very common passage does not meet in one task.
3. A shard builds FM-indexes over its segments (distinct words are its alphabet)
   and streams the segments through them: backward search gives, for every place,
   how often the window from there occurs. Places with two or more are reported.
4. Reported ranges go back to their documents, and covered words are left out.

Words are compared as words; hashes only choose where they meet.

Defined results: null and empty texts have no words; rows that repeat both id and
text repeat each other's windows; rows that repeat an id alone are documents of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formulary.llm import words
from formulary.llm.fm_index import FMIndex
from formulary.llm.storage import written

U64 = np.uint64
WINDOW = 35
GRAM = 8
#: Segments of a key above which its windows are dealt out one by one.
HOT = 50_000
#: Words of one index, but for what one key needs.
INDEX_WORDS = 400_000
#: Keys that a task combines before it passes them on.
FLUSH = 400_000


def least_in_windows(g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value of each stretch of ``width``, and its first and last place."""
    value, first = g, np.arange(len(g))
    last, span = first, 1
    while span < width:
        step = min(span, width - span)
        a, b = value[:-step], value[step:]
        value, first, last = np.minimum(a, b), np.where(a <= b, first[:-step], first[step:]), np.where(b <= a, last[step:], last[:-step])
        span += step
    return value, first, last


def segments(h: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of hashed words of rows that start at ``at``: key, row, first window, number of windows, and occurrences of each segment."""
    n = np.diff(at)
    if len(h) < window or n.max(initial=0) < window:
        return tuple(np.empty(0, t) for t in (U64, np.int64, np.int64, np.int64, np.int64))
    key, first, last = least_in_windows(words.grams(h, gram), window - gram + 1)
    row = np.repeat(np.arange(len(n)), n)[: len(key)]
    inside = np.arange(len(key)) + window <= at[1:][row]
    place = np.flatnonzero(inside)
    k, r = key[place], row[place]
    begin = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
    end = np.r_[begin[1:], len(place)] - 1
    several = first[place[begin]] != last[place[end]]
    return k[begin], r[begin], place[begin], end - begin + 1, 1 + several.astype(np.int64)


def hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, rows = words.flat(batch.column("text"))
    starts, ends, at = words.spans(data, rows)
    return data, starts, ends, at, words.hashes(data, starts, ends)


def repeated_keys(docs: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """rid, keys, hot: the keys of each document that occur more than once, and which of them are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0
        for batch in batches:
            for part in words.text_slices(batch):
                _, _, _, at, h = hashed(part)
                key, row, _, _, n = segments(h, at, window, gram)
                held.append((key, part.column("rid").to_numpy()[row] if len(row) else np.empty(0, np.int64), n))
                count += len(key)
                if count >= FLUSH:
                    yield combined(held)
                    held, count = [], 0
        if count:
            yield combined(held)

    found = docs.select("rid", "text").mapInArrow(run, "key bigint, n bigint, rids array<bigint>")
    total = found.withColumn("total", F.sum("n").over(W.partitionBy("key"))).where("total > 1")
    each = total.select("key", (F.col("total") > hot).alias("hot"), F.explode("rids").alias("rid"))
    return each.groupBy("rid").agg(F.collect_list("key").alias("keys"), F.collect_list("hot").alias("hot"))  # of one document


def combined(held: list[tuple]) -> pa.RecordBatch:
    key, rid, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((rid, key))
    key, rid, n = key[order], rid[order], n[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    totals = np.add.reduceat(n, at)
    new = np.r_[True, (key[1:] != key[:-1]) | (rid[1:] != rid[:-1])]
    sizes = np.add.reduceat(new.astype(np.int64), at)
    rids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(rid[new]))
    return pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(totals), rids], ["key", "n", "rids"])


def shard_rows(joined: DataFrame, window: int, gram: int) -> DataFrame:
    """key, segment, rids, starts: segments whose key is repeated; equal ones of a slice are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.text_slices(batch):
                data, starts, ends, at, h = hashed(part)
                key, row, first, n, _ = segments(h, at, window, gram)
                listed = part.column("keys")
                wanted = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(pc.list_value_length(listed).to_numpy())], pa.int32()), listed.flatten())
                owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(listed).to_numpy())
                # A pair of row and key as one hash, to look many up at once.
                tag = lambda r, k: words.mix(words.mix(k) + r.astype(U64))
                have = tag(owner, wanted.flatten().to_numpy().view(U64))
                is_hot = part.column("hot").flatten().to_numpy(zero_copy_only=False).astype(bool)
                order = np.argsort(have)
                have, is_hot = have[order], is_hot[order]
                asked = tag(row, key)
                spot = np.minimum(np.searchsorted(have, asked), max(0, len(have) - 1))
                hit = have[spot] == asked if len(have) else np.zeros(len(asked), bool)
                whole = words.grams(h, window) if is_hot.any() else None
                rid = part.column("rid").to_numpy()
                found: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
                raw = data.tobytes()
                base = at[:-1]
                for i in np.flatnonzero(hit).tolist():
                    f, r = int(first[i]), int(row[i])
                    if is_hot[spot[i]]:
                        for w in range(f, f + int(n[i])):
                            found.setdefault((int(whole[w].view(np.int64)), raw[starts[w] : ends[w + window - 1]]), []).append((int(rid[r]), w - int(base[r])))
                    else:
                        found.setdefault((int(key[i].view(np.int64)), raw[starts[f] : ends[f + int(n[i]) + window - 2]]), []).append((int(rid[r]), f - int(base[r])))
                columns = [[k for k, _ in found], [s for _, s in found], [[a for a, _ in v] for v in found.values()], [[b for _, b in v] for v in found.values()]]
                types = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                columns[1] = [s.decode() for s in columns[1]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "segment", "rids", "starts"])

    return joined.mapInArrow(run, "key bigint, segment string, rids array<bigint>, starts array<bigint>")


def repeated_places(rows: list[tuple], window: int) -> list[tuple[int, int, int]]:
    """rid, from, to: ranges of words that repeated windows cover, from one index over the rows' segments."""
    split = pc.ascii_split_whitespace(pa.array([r[1] for r in rows], pa.string()))
    lengths = pc.list_value_length(split).to_numpy().astype(np.int64)
    encoded = split.flatten().dictionary_encode()
    starts = np.r_[0, np.cumsum(lengths + 1)][:-1]
    text = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
    own = np.repeat(np.arange(len(rows)), lengths)
    text[np.arange(len(own)) + own] = encoded.indices.to_numpy() + 1
    weights = np.repeat(np.array([len(r[2]) for r in rows], dtype=np.int64), lengths + 1)
    counts = FMIndex(text, window, weights).statistics(text, starts, lengths)
    again = np.flatnonzero(counts >= 2)
    if not len(again):
        return []
    begin = np.flatnonzero(np.r_[True, np.diff(again) != 1])
    end = np.r_[begin[1:], len(again)] - 1
    out = []
    for a, b in zip(again[begin].tolist(), again[end].tolist(), strict=True):
        i = int(np.searchsorted(starts, a, side="right")) - 1
        low, high = a - int(starts[i]), b - int(starts[i]) + window
        out += [(rid, start + low, start + high) for rid, start in zip(rows[i][2], rows[i][3], strict=True)]
    return out


def reported(shards: DataFrame, window: int) -> DataFrame:
    """rid, low, high of every range of words that is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            found = repeated_places(held, window)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["rid", "low", "high"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size >= INDEX_WORDS and row[0] != held[-1][0]:
                    yield packed()
                    held, size = [], 0
                held.append(row)
                size += row[1].count(" ") + 2
        if held:
            yield packed()

    return shards.repartition("key").sortWithinPartitions("key").mapInArrow(run, "rid bigint, low bigint, high bigint")


def deduped(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for every row."""
    base = docs.select("doc_id", F.xxhash64(F.lit(1), "doc_id", "text").alias("rid"), "text")
    keys = written(repeated_keys(base, window, gram, hot), "repeated-keys")
    # Both joins want the documents by rid with the same columns, so they are shuffled once.
    ranges = reported(shard_rows(base.join(keys, "rid"), window, gram), window)
    ranges = ranges.groupBy("rid").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))  # of one document
    ranges = ranges.select("rid", F.transform("ranges", lambda r: r["low"]).alias("low"), F.transform("ranges", lambda r: r["high"]).alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, low, high in zip(batch.column("text").cast(pa.binary()), batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
                w = (text.as_py() or b"").split()  # of bytes, at 0x20 and 0x09-0x0D
                stay = w
                if low:
                    edge = np.zeros(len(w) + 1, dtype=np.int64)
                    np.add.at(edge, low, 1)
                    np.add.at(edge, high, -1)
                    stay = [w[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                n.append(len(w))
                gone.append(len(w) - len(stay))
                kept.append(b" ".join(stay).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = base.join(ranges, "rid", "left").select("doc_id", "rid", "text", "low", "high")
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
