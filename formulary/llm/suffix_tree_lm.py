"""Language-model scores by a probabilistic suffix tree over words.

A text is its tokens: its words, A-Z lower-cased, then one end. A context is some
consecutive tokens; a text begins after an end. The tree holds contexts, each with
the tokens that followed it in training texts, and grows from the empty context:

* The empty context is the base: (c + 0.5) / (N + 0.5 (V + 1)) for a token counted
  c times; all tokens that training does not have are one symbol with c = 0.
* A longer context is judged if the context without its first token stays. It
  stays if N(s) * divergence(s || shorter) >= BITS + N(s) / STEPS, so that a tree has
  no greatest depth, and grows with the corpus. The divergence is between what follows s, with
  all followers seen once taken together, and the shorter context's probabilities:
  sum of n log2(n / (N p)) over followers with n >= 2, and
  N1 log2((N1 + PRIOR) / (N + PRIOR)) for the N1 seen once.
* Smoothing: P(w|s) = (n' + (N1 + PRIOR) * P(w|shorter)) / (N + PRIOR), with n' the
  count n where it is at least 2, else 0. What was seen once stands for what was
  not seen, and its share goes to the shorter context.
* A token is scored in the longest context of the tree that it follows.

In the test alone, log2 p is rounded to one STEPS-th of a bit; what is asked for
beside BITS is twice the greatest error of that.

The tree is never in one place. A block is some consecutive rows of a file, read
once and kept as numbers in the shared folder. For contexts of one length after the
other, each block asks for its different contexts and their followers, packed; a
bucket, by the context without its first token, adds up what all blocks ask, judges,
and answers in the order of what the block asked. Answers are files in the shared
folder; where lengths grow, only the places that the tree still reaches are kept, and
the others' probabilities are added up by row. A context of over one HOT-th of all tokens is dealt out by
its followers instead, and what its buckets add up (a few numbers for each of at
most HOT contexts) meets on the driver. A follower can occur twice behind a context
only if it does behind the shorter one, and the context only if it occurs twice; and
what contexts one token longer can save is at most the sum of -n log2 P(w|s) over
followers with n >= 2; and a context that occurs m times can save at most
m log2(N / m), N being the size of the shorter one. What cannot stay by these
bounds is not asked for, which loses none.

Tokens and contexts are known by 64-bit hashes. A word that training has gets a
number from its bucket, the lower the more frequent, by which followers are asked
for, as it takes fewer bytes.

Defined results: a null or empty text is an end alone; rows that repeat an id are
documents of their own; rows without an id are not learned from; with nothing to
learn from, every token has the base's probability; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formulary.llm import words
from formulary.llm.storage import dropped, fresh_path, lean, opened_folder, written

U64 = np.uint64
#: Bits that a context must save to stay.
BITS = 12.0
#: Weight of the shorter context beside what was seen once, in tokens.
PRIOR = 0.5
#: Steps of a bit to which logarithms are rounded for the test.
STEPS = 32
END = U64(1)
#: Bytes of text of a block, on average.
BLOCK_BYTES = 8 << 20
#: Folders of answers.
SHELVES = 2048
#: Contexts of up to this length are followed anew in each pass; beyond, few places are left, and these are kept.
ANEW = 3
#: Tokens of text for each bucket.
BUCKET_TOKENS = 1 << 20
#: Bytes of text for each bucket of words.
WORD_BYTES = 64 << 20
#: Blocks that are handed to Python at once.
BLOCK_ROWS = "4"
#: A context is dealt out by followers if it has more than one token in so many.
HOT = 1000
#: A context of fewer tokens is never dealt out.
LEAST_HOT = 50_000


def learned(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) != 1, F.lit(False))


def found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each asked one is among different keys, and where."""
    spot = pc.fill_null(pc.index_in(pa.array(asked), value_set=pa.array(keys)), -1).to_numpy(zero_copy_only=False)
    return spot >= 0, spot


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and of each one its place among them."""
    order = np.argsort(x)
    held = x[order]
    first = np.ones(len(x), dtype=bool)
    first[1:] = held[1:] != held[:-1]
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.cumsum(first) - 1
    return held[first], place


def packed(x: np.ndarray, level: int = 1) -> bytes:
    """Bytes of numbers by place, compressed; whole numbers of 0 or more in as many bytes as the largest takes."""
    if not len(x):
        return b""
    if x.dtype.kind != "f":
        x = x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, U64) if int(x.max()) <= np.iinfo(t).max))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return bytes([x.itemsize]) + len(x).to_bytes(4, "little") + pa.Codec("zstd", compression_level=level).compress(planes, asbytes=True)


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    width, n = data[0], int.from_bytes(data[1:5], "little")
    planes = np.frombuffer(pa.decompress(memoryview(data)[5:], n * width, codec="zstd"), dtype=np.uint8).reshape(width, n)
    x = np.ascontiguousarray(planes.T).reshape(-1)
    return x.view(kind) if np.dtype(kind).kind == "f" else x.view(f"u{width}").astype(kind)


def sparse(x: np.ndarray) -> bytes:
    """Numbers of which many are 0: how many there are, which are more, and these."""
    some = x > 0
    flags = pa.compress(np.packbits(some), codec="zstd", asbytes=True)
    return len(x).to_bytes(4, "little") + len(flags).to_bytes(4, "little") + flags + packed(x[some])


def unsparse(data: bytes) -> np.ndarray:
    n, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    out = np.zeros(n, dtype=np.int64)
    if n:
        flags = np.frombuffer(pa.decompress(memoryview(data)[8 : 8 + size], (n + 7) // 8, codec="zstd"), dtype=np.uint8)
        out[np.unpackbits(flags, count=n).astype(bool)] = unpacked(data[8 + size :])
    return out


def stepped(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Steps between numbers that rise within runs; a run starts anew."""
    steps = x.copy()
    steps[1:] = np.where(start[1:], x[1:], x[1:] - x[:-1])
    return steps


def unstepped(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers again, from the sizes of the runs."""
    sizes = sizes[sizes > 0]
    upto = np.cumsum(steps, dtype=U64)
    first = np.cumsum(sizes) - sizes
    return upto - np.repeat(upto[first] - steps[first], sizes)


def folded(x: np.ndarray) -> np.ndarray:
    """Small numbers below 0 as small ones above."""
    return (x << 1) ^ (x >> 63)


def unfolded(x: np.ndarray) -> np.ndarray:
    return (x >> 1) ^ -(x & 1)


def starts(sizes: np.ndarray) -> np.ndarray:
    """Whether each item is the first of its run."""
    first = np.zeros(int(sizes.sum()), dtype=bool)
    sizes = sizes[sizes > 0]
    first[np.cumsum(sizes) - sizes] = True
    return first


def ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)


def extended(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hash of contexts with one more token in front."""
    return words.mix(context * U64(0xA24BAED4963EE407) + token)


def read(block: int, buckets: int, parts: list[pa.RecordBatch]) -> tuple[dict, list[dict]]:
    """Rows of a block as one of PIECES, and what it asks buckets about its tokens.

    Tokens are told by the bucket of their hash and their rank in it by frequency in the block.
    """
    tokens, counts = [], []
    for part in parts:
        data, rows = words.flat(part.column("text"))
        data = words.LOWER[data]
        begin, end, at = words.spans(data, rows)
        h = words.hashes(data, begin, end)
        h[h == END] = U64(2)
        n = np.diff(at)
        out = np.full(len(h) + len(n), END)
        out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
        tokens.append(out)
        counts.append(n + 1)
    joined = lambda name: np.concatenate([p.column(name).to_numpy(zero_copy_only=False) for p in parts])
    count, learn = np.concatenate(counts), joined("learn").astype(bool)
    key, place = coded(np.concatenate(tokens))
    n = np.bincount(place, weights=np.repeat(learn, count), minlength=len(key)).astype(np.int64)
    bucket = (words.mix(key) % U64(buckets)).astype(np.int64)
    order = np.lexsort((-np.bincount(place), bucket))  # of equal frequency, in order of their hashes
    size = np.bincount(bucket, minlength=buckets)
    code = np.empty(len(key), dtype=np.int64)
    code[order] = ranges(np.zeros(buckets, np.int64), size) * buckets + bucket[order]
    ids = pa.chunked_array([p.column("doc_id") for p in parts])
    # The same rows, read again, may be dealt to tasks in other pieces.
    name = int(words.mix(np.array([block], np.int64).view(U64) + U64(int(parts[0].column("row")[0].as_py())))[0].view(np.int64))
    piece = {"block": name, "rows": len(count), "doc_id": pc.fill_null(ids, 0).to_numpy().astype(np.int64).tobytes(), "no_id": packed(ids.is_null().to_numpy().astype(np.uint8)), "counts": packed(count), "learn": packed(learn.astype(np.uint8)), "tokens": packed(code[place], 9)}
    upto = np.r_[0, np.cumsum(size)]
    asked = [{"bucket": b, "block": name, "hot": False, "above": packed(np.diff(key[order[x:y]], prepend=U64(0))), "n": packed(n[order[x:y]])} for b, (x, y) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)) if y > x]
    return piece, asked


class Block:
    """Tokens of rows by their kinds, in order of their numbers, and how far the tree's contexts reach at each of them."""

    def __init__(self, piece: dict, answers: list[dict], buckets: int):
        self.name = piece["block"]
        self.counts = unpacked(piece["counts"])
        self.begin = np.r_[0, np.cumsum(self.counts)]
        tokens = unpacked(piece["tokens"])
        n, ids = np.zeros(int(tokens.max()) + 1, np.int64), np.zeros(int(tokens.max()) + 1, np.int64)
        for r in answers:
            told = unpacked(r["n"])
            at = np.arange(len(told)) * buckets + r["bucket"]
            n[at], ids[at] = told, unpacked(r["ids"])
        order = np.argsort(ids)
        kind = np.empty(len(ids), dtype=np.int64)
        kind[order] = np.arange(len(ids))
        self.ids, self.times = ids[order].astype(U64), n[order]
        self.tokens = kind[tokens]
        self.held = np.r_[self.tokens[self.begin[1] - 1], self.tokens]  # a row stands behind the end of the one before it
        self.count = self.times[self.tokens]
        self.learn = np.repeat(unpacked(piece["learn"]).astype(bool), self.counts)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def history(self) -> np.ndarray:
        """Tokens that stand before each one, with the end before its text."""
        return np.arange(1, len(self.tokens) + 1) - self.begin[self.row]

    def start(self, floor: float, buckets: int) -> None:
        """Counts and probabilities of the empty context; ``at`` are the places that the tree goes on from."""
        self.bits = np.clip(np.rint(-STEPS * np.log2((self.times + 0.5) / floor)), 0, 65535).astype(np.int64)
        self.base = (self.count + 0.5) / floor
        self.p = self.base.copy()
        self.at, self.n, self.room = np.arange(len(self.tokens)), self.count, np.full(len(self.tokens), floor)
        #: Of each place, the context it stands behind, among ``codes``.
        self.inner, self.codes = np.zeros(len(self.tokens), np.int64), np.zeros(1, U64)
        #: Over how many buckets the contexts are spread that have one of ``codes`` as the shorter one.
        self.spread = np.array([buckets])
        #: Of each place, how often its token follows the context asked for last, if twice at least; -1 where none was.
        self.follows = self.count
        #: Of what ends behind each token held, as long as the contexts to ask for next, at most how many there are.
        self.cap = self.times[self.held]
        self.then: np.ndarray | None = None

    def step(self, depth: int, bits: float, hot: int) -> None:
        """On to the contexts with one more token in front, where there is one, and where it can occur often enough to stay."""
        on = self.history[self.at] >= depth if depth > 1 else slice(None)
        at = self.at[on]
        # How often the last token follows what stands before it in the context, where that was asked for.
        prior = self.follows[at - 1] if depth > 1 else self.cap[at]
        may = worth(self.cap[at], self.room[on], bits)
        self.at, self.n, self.inner = at[may], self.n[on][may], self.inner[on][may]
        self.ask(depth, prior[may] > hot)

    def ask(self, depth: int, much: np.ndarray) -> None:
        """The different contexts of ``at``, by the shorter context and the token in front, and what follows them."""
        self.above, self.wide, self.much = self.codes, self.spread, much
        self.parent = self.inner
        front = self.held[self.at + 1 - depth]
        if depth == 1:
            key = np.flatnonzero(np.bincount(front, minlength=len(self.ids)))
            spot = np.zeros(len(self.ids), dtype=np.int64)
            spot[key] = np.arange(len(key))
            self.inner = spot[front]
        else:
            key, self.inner = coded((self.inner << 32) | front)
        self.owner, self.front = key >> 32, key & 0xFFFFFFFF
        front = self.ids[self.front]
        self.codes = front if depth == 1 else extended(self.above[self.owner], front)
        self.dealt = np.zeros(len(key), dtype=bool)
        self.dealt[self.inner[much]] = True
        self.some = np.flatnonzero(self.n >= 2)
        self.pair, self.back = coded((self.inner[self.some] << 32) | self.tokens[self.at[self.some]])

    def homes(self, buckets: int) -> np.ndarray:
        """The bucket of each context; those with one shorter context are together, but for a frequent one's."""
        above = (words.mix(self.above ^ U64(0x51)) % U64(buckets)).astype(np.int64)[self.owner]
        return (above + (words.mix(self.ids[self.front]) % self.wide[self.owner].astype(U64)).astype(np.int64)) % buckets

    def lay(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How contexts and followers are dealt to buckets: the bucket, context and number of followers of each item, and the followers in order.

        A context goes to a bucket with all of its followers. One that is dealt out goes with
        each of its followers to the follower's bucket, and with its size to its own.
        """
        home = 2 * self.homes(buckets)
        of, dealt = self.pair >> 32, np.flatnonzero(self.dealt)
        n = np.bincount(of, minlength=len(home))
        upto = np.cumsum(n)
        apart = np.flatnonzero(self.dealt[of])
        to = 2 * (words.mix(self.ids[self.pair[apart] & 0xFFFFFFFF]) % U64(buckets)).astype(np.int64) + 1
        each = (to << 32) | of[apart]
        order = np.argsort(each, kind="stable")
        apart, each = apart[order], each[order]
        items = np.union1d(each, ((home[dealt] + 1) << 32) | dealt)
        begin = np.searchsorted(each, items)
        own = np.flatnonzero(~self.dealt)
        group, context = np.r_[home[own], items >> 32], np.r_[own, items & 0xFFFFFFFF]
        first, size = np.r_[(upto - n)[own], len(of) + begin], np.r_[n[own], np.searchsorted(each, items, side="right") - begin]
        order = np.argsort((group << 32) | context)
        group, context, first, size = group[order], context[order], first[order], size[order]
        return group, context, size, np.r_[np.arange(len(of)), apart][ranges(first, size)]

    def questions(self, buckets: int, depth: int) -> list[dict]:
        """A row for each bucket, and one more for contexts that are dealt out by followers."""
        group, context, kinds, order = self.lay(buckets)
        learn = self.learn[self.at]
        size = np.bincount(self.inner, weights=learn, minlength=len(self.codes)).astype(np.int64)[context]
        home = 2 * self.homes(buckets) + self.dealt
        size[group != home[context]] = 0
        n = np.bincount(self.back, weights=learn[self.some], minlength=len(self.pair)).astype(np.int64)[order]
        follower = (self.pair & 0xFFFFFFFF)[order]
        item = np.repeat(np.arange(len(group)), kinds)
        size -= np.where(self.dealt[context], 0, np.bincount(item, weights=n, minlength=len(group)).astype(np.int64))  # what is told by the followers
        if depth > 1:
            p = np.empty(len(self.pair))
            p[self.back] = self.p[self.at[self.some]]
            bits = np.clip(np.rint(-STEPS * np.log2(p)), 0, 65535).astype(np.int64)[order]
        else:
            bits = self.bits[follower]
        behind = (self.owner[self.pair >> 32][order] << 32) | follower
        anew = np.ones(len(group), dtype=bool)
        anew[1:] = group[1:] != group[:-1]
        fork = anew.copy()
        fork[1:] |= self.owner[context[1:]] != self.owner[context[:-1]]
        fronts, grams = stepped(self.ids[self.front[context]], fork), stepped(self.ids[follower], starts(kinds))
        forks = np.flatnonzero(fork)
        width = np.diff(np.r_[forks, len(group)])
        a = np.r_[np.flatnonzero(anew), len(group)]
        f, g = np.searchsorted(forks, a), np.r_[0, np.cumsum(kinds)][a]
        above = self.above[self.owner[context[forks]]]
        rows = []
        for i in range(len(a) - 1):
            items, up, down = slice(a[i], a[i + 1]), slice(f[i], f[i + 1]), slice(g[i], g[i + 1])
            key = int(group[a[i]])
            # Followers have one probability behind the shorter context, however many contexts have it.
            different, place = coded(behind[down])
            told = np.empty(len(different), dtype=np.int64)
            told[place] = bits[down]
            if depth == 1:  # in order of frequency
                told = folded(np.diff(told, prepend=0))
            rows.append({"bucket": key >> 1, "block": self.name, "hot": bool(key & 1), "above": packed(above[up]), "forks": packed(width[up]), "fronts": packed(fronts[items]), "size": packed(size[items]), "kinds": packed(kinds[items]), "grams": packed(grams[down]), "n": packed(n[down]), "bits": packed(told)})
        return rows

    def follow(self, level: Level) -> None:
        """What is told of the contexts asked for: how often tokens follow them, and which of them stay, with ``p`` in these."""
        group, context, kinds, order = self.lay(level.buckets)
        rows = sorted(level.rows(self.name), key=lambda r: (r["bucket"], r["hot"]))
        join = lambda name, opened: np.concatenate([np.empty(0, np.int64), *(opened(r[name]) for r in rows)])
        told, n = join("size", unsparse), join("n", unsparse)
        if len(told) != len(context) or len(n) != len(order):
            raise RuntimeError("answers are not to the questions of this block")
        size, once, pair = np.zeros(len(self.codes), np.int64), np.zeros(len(self.codes), np.int64), np.zeros(len(self.pair), np.int64)
        stays = told > 0  # twice the size, and one more if longer contexts may stay
        size[context[stays]], once[context[stays]], pair[order] = told[stays], join("once", unpacked), n
        if len(level.hot[0]) and self.dealt.any():
            dealt = np.flatnonzero(self.dealt)
            has, spot = found(level.hot[0], self.codes[dealt])
            size[dealt[has]], once[dealt[has]] = 2 * level.hot[1][spot[has]] + 1, level.hot[2][spot[has]]
        times = np.zeros(len(self.at), dtype=np.int64)
        times[self.some] = pair[self.back]
        self.follows = np.full(len(self.tokens), -1, dtype=np.int64)
        self.follows[self.at] = times
        self.cap = np.minimum(self.cap, np.r_[self.cap[:1], self.cap[:-1]]) if self.then is None else self.then
        self.then = None
        self.cap[self.at + 1] = times
        on = size[self.inner] > 0
        self.at, self.inner, self.n = self.at[on], self.inner[on], times[on]
        self.spread = np.minimum(1 + (size >> 1) // level.each, level.buckets)
        self.room = (size >> 1)[self.inner] + PRIOR
        self.p[self.at] = (self.n + (once[self.inner] + PRIOR) * self.p[self.at]) / self.room
        more = (size & 1)[self.inner] > 0
        self.at, self.inner, self.n, self.room = self.at[more], self.inner[more], self.n[more], self.room[more]

    def walk(self, levels: list[Level], bits: float) -> None:
        for depth, level in enumerate(levels, 1):
            self.step(depth, bits, level.much)
            self.follow(level)

    def sums(self, left: np.ndarray) -> np.ndarray:
        """Of each row, log10 of what its tokens' probabilities at some places come to."""
        return np.bincount(self.row[left], weights=np.log10(self.p[left]), minlength=len(self.counts)).astype(np.float64)  # whole numbers where there are none

    def state(self, left: np.ndarray) -> dict:
        """What resume() needs, and the sums of the places ``left``, which the tree does not go on from."""
        most = np.minimum(self.cap[self.at], self.cap[self.at - 1])
        used, parent = coded(self.parent)
        kept = {"at": packed(stepped(self.at, np.arange(len(self.at)) == 0)), "p": packed(self.p[self.at]), "n": packed(self.n), "parent": packed(parent), "above": packed(self.above[used]), "wide": packed(self.wide[used]), "most": packed(most), "much": packed(self.much.astype(np.uint8))}
        return {"block": self.name, "n_at": len(self.at), "sums": packed(self.sums(left)), "rest": packed(self.sums(self.at)), **kept}

    def resume(self, depth: int, kept: dict) -> None:
        """As after step(depth)."""
        self.at = np.cumsum(unpacked(kept["at"]))
        self.n, much = unpacked(kept["n"]), unpacked(kept["much"]).astype(bool)
        self.p = np.ones(len(self.tokens))
        self.p[self.at] = unpacked(kept["p"], np.float64)
        self.then = np.full(len(self.held), np.iinfo(np.int64).max)
        self.then[self.at] = unpacked(kept["most"])
        self.inner, self.codes, self.spread = unpacked(kept["parent"]), unpacked(kept["above"], U64), unpacked(kept["wide"])
        self.ask(depth, much)


ASKED = "bucket bigint, block bigint, hot boolean, above binary, forks binary, fronts binary, size binary, kinds binary, grams binary, n binary, bits binary"
NAMES = [x.split()[0] for x in ASKED.split(", ")]
PIECES = "block bigint, rows bigint, doc_id binary, no_id binary, counts binary, learn binary, tokens binary"
PLACES = "block bigint, n_at bigint, sums binary, rest binary, at binary, p binary, n binary, parent binary, above binary, wide binary, most binary, much binary, known binary, base binary"
PART = "array<struct<context: bigint, size: bigint, twice: bigint, gain: double, kinds: bigint, stays: bigint>>"
TOLD = f"block bigint, bucket bigint, hot boolean, size binary, once binary, n binary, ids binary, part {PART}"
PARTS = pa.list_(pa.struct([("context", pa.int64()), ("size", pa.int64()), ("twice", pa.int64()), ("gain", pa.float64()), ("kinds", pa.int64()), ("stays", pa.int64())]))
KINDS = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def merged(*schemas: str) -> str:
    """Columns of several schemas, each once."""
    return ", ".join(dict.fromkeys(x for schema in schemas for x in schema.split(", ")))


def fields(schema: str) -> pa.Schema:
    return pa.schema([(name, KINDS.get(kind, PARTS)) for name, kind in (x.split(" ", 1) for x in schema.replace(f", part {PART}", ", part array").split(", "))])


def batch_of(rows: list[dict], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=fields(schema))


def gains(size: np.ndarray, twice: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Bits that contexts save beyond what rounding may make: ``gain`` is the sum of n log2(n / p) over followers with n >= 2, ``twice`` that of n."""
    once = size - twice
    with np.errstate(divide="ignore", invalid="ignore"):
        return gain - size / STEPS - np.where(twice > 0, twice * np.log2(np.maximum(size, 1)), 0) + np.where(once > 0, once * np.log2((once + PRIOR) / (size + PRIOR)), 0)


def worth(most: np.ndarray, room: np.ndarray, bits: float) -> np.ndarray:
    """Whether contexts that occur at most so often may stay, ``room`` being what divides the shorter context's probabilities.

    A follower that n of m times is behind the context has p >= n / room behind the shorter one, so
    gains() is at most m log2(room / m), which grows up to room / e.
    """
    m = np.minimum(np.maximum(most, 1), room / np.e)
    return (most >= 2) & (m * np.log2(room / m) >= bits - 1e-6)


def numbered(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """What a bucket does with the tokens: adds up, and numbers them by frequency, beside the other buckets."""

    def run(bucket: pa.Table) -> pa.Table:
        rows = bucket.select(["block", "bucket", "above", "n"]).to_pylist()
        asked = [np.cumsum(unpacked(r["above"], U64), dtype=U64) for r in rows]
        key, place = coded(np.concatenate(asked))
        n = np.bincount(place, weights=np.concatenate([unpacked(r["n"]) for r in rows]), minlength=len(key)).astype(np.int64)
        ids = np.empty(len(key), dtype=np.int64)
        ids[np.lexsort((key, -n))] = np.arange(len(key)) * buckets + rows[0]["bucket"] + 1
        ids[n == 0] = 0  # without a number, what a word follows is never looked up
        upto, out = np.r_[0, np.cumsum([len(x) for x in asked])], []
        for i, r in enumerate(rows):
            at = place[upto[i] : upto[i + 1]]
            out.append({"block": r["block"], "bucket": r["bucket"], "n": packed(n[at]), "ids": packed(ids[at]), "part": []})
        out[0]["part"] = [{"context": 0, "size": int(n.sum()), "twice": 0, "gain": 0.0, "kinds": int((n > 0).sum()), "stays": 0}]
        return pa.Table.from_pylist(out, schema=fields(TOLD))

    return run


def answered(bits_needed: float, depth: int) -> Callable[[pa.Table], pa.Table]:
    """What a bucket does with contexts: adds up, judges, and answers each row, in the order of what it asks."""

    def run(bucket: pa.Table) -> pa.Table:
        rows = bucket.to_pylist()
        column = lambda name, kind=np.int64: [unpacked(r[name], kind) for r in rows]
        kinds, forks, grams = column("kinds"), np.concatenate(column("forks")), column("grams", U64)
        n_contexts, n_grams = [len(x) for x in kinds], [len(x) for x in grams]
        kinds = np.concatenate(kinds)
        fronts = unstepped(np.concatenate(column("fronts", U64)), forks)
        every = fronts if depth == 1 else extended(np.repeat(np.concatenate(column("above", U64)), forks), fronts)
        key, back = coded(every)
        dealt = np.zeros(len(key), dtype=bool)
        dealt[back[np.repeat([r["hot"] for r in rows], n_contexts)]] = True
        ids = unstepped(np.concatenate(grams), kinds)
        begin, upto = np.r_[0, np.cumsum(n_contexts)], np.r_[0, np.cumsum(n_grams)]
        bits = column("bits")
        if depth == 1:
            bits = [np.cumsum(unfolded(b)) for b in bits]
        behind = (np.repeat(np.repeat(np.arange(len(forks)), forks), kinds).astype(U64) << U64(32)) | ids
        bits = [b[coded(behind[upto[i] : upto[i + 1]])[1]] for i, b in enumerate(bits)]
        at, times = np.repeat(back, kinds), np.concatenate(column("n"))
        size = np.bincount(back, weights=np.concatenate(column("size")), minlength=len(key)).astype(np.int64)
        size += np.bincount(at, weights=np.where(dealt[at], 0, times), minlength=len(key)).astype(np.int64)
        g, place = coded((at.astype(U64) << U64(32)) | ids)
        n = np.bincount(place, weights=times, minlength=len(g)).astype(np.int64)
        of, weight = (g >> U64(32)).astype(np.int64), np.empty(len(g), np.int64)
        weight[place] = np.concatenate(bits)
        two = n >= 2
        twice = np.bincount(of[two], weights=n[two], minlength=len(key)).astype(np.int64)
        gain = np.bincount(of[two], weights=n[two] * (np.log2(n[two]) + weight[two] / STEPS), minlength=len(key))
        stays = (gains(size, twice, gain) >= bits_needed) & ~dealt
        whole = two & ~dealt[of]  # of a context that is dealt out, a bucket knows a part only
        p = (n[whole] + (size - twice + PRIOR)[of[whole]] * 2.0 ** (-weight[whole] / STEPS)) / (size + PRIOR)[of[whole]]
        left = np.bincount(of[whole], weights=-n[whole] * np.log2(np.minimum(p, 1)), minlength=len(key))
        more = left >= bits_needed - 1 - size / STEPS  # with room for rounding
        sizes, once, times = np.where(stays, 2 * size + more, 0)[back], (size - twice)[back], np.where(two, n, 0)[place]
        out = []
        for i, r in enumerate(rows):
            c = slice(begin[i], begin[i + 1])
            out.append({"block": r["block"], "bucket": r["bucket"], "hot": r["hot"], "size": sparse(sizes[c]), "once": packed(once[c][sizes[c] > 0]), "n": sparse(times[upto[i] : upto[i + 1]]), "part": []})
        part = [{"context": int(key[i].view(np.int64)), "size": int(size[i]), "twice": int(twice[i]), "gain": float(gain[i]), "kinds": 0, "stays": 0} for i in np.flatnonzero(dealt)]
        part.append({"context": None, "size": 0, "twice": 0, "gain": 0.0, "kinds": 0, "stays": int(stays.sum())})
        out[0]["part"] = part
        return pa.Table.from_pylist(out, schema=fields(TOLD))

    return run


@dataclass(frozen=True)
class Level:
    """Where the answers for contexts of one length are, and the contexts that were dealt out and stay."""

    path: str
    buckets: int
    #: A context that occurs more often was dealt out.
    much: int
    #: Contexts one longer are spread over one bucket more for each so many times that it occurs.
    each: int
    hot: tuple[np.ndarray, np.ndarray, np.ndarray]

    def rows(self, block: int) -> list[dict]:
        return shelved(self.path, block, ["bucket", "hot", "size", "once", "n", "ids"])


def shelf(block: int | Column) -> int | Column:
    """Blocks share folders, of which there are so many whatever the corpus."""
    return F.pmod(block, F.lit(SHELVES)) if isinstance(block, Column) else block % SHELVES


def shelve(df: DataFrame, path: str) -> None:
    """Rows of a block in one file."""
    df.withColumn("shelf", shelf(F.col("block"))).repartition("shelf").sortWithinPartitions("shelf", "block").write.partitionBy("shelf").parquet(path)


def shelved(path: str, block: int, columns: list[str]) -> list[dict]:
    return [row for source in opened_folder(f"{path}/shelf={shelf(block)}", columns, ("block", block)) for row in source.to_pylist()]


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Consecutive rows of one block each."""
    held, block = [], None
    for batch in batches:
        for part in words.text_slices(batch):
            ids = part.column("block").to_numpy()
            cuts = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and ids[a] != block:
                    yield block, held
                    held = []
                block = int(ids[a])
                held.append(part.slice(a, b - a))
    if held:
        yield block, held


def placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, row (of its file), text, learn and block, blocks in order; and buckets for the words."""
    narrow = [F.col("doc_id").cast("bigint").alias("doc_id"), "text", learned(F.col("doc_id")).alias("learn")]
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        docs = docs.select(*narrow, *where)
    except AnalysisException:  # not read from files
        docs = written(docs.select("doc_id", "text"), "lm-texts").select(*narrow, *where)
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    each = max(1, int(BLOCK_BYTES * rows // max(1, size or 0)))
    return docs.select("doc_id", "row", "text", "learn", F.xxhash64("file", F.floor(F.col("row") / each)).alias("block")), max(64, int(size or 0) // WORD_BYTES)


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Rows that hold whole blocks go to Python a few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BLOCK_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def told(asked: DataFrame, path: str, answer: Callable[[pa.Table], pa.Table]) -> pa.Table:
    """Writes what buckets answer; what they add up of contexts that are dealt out."""
    spark, plain = asked.sparkSession, f"{path}-plain"
    asked.groupBy("bucket").applyInArrow(answer, TOLD).write.parquet(plain)
    dropped(spark)  # the questions, before the answers are shelved
    dropped(spark)  # only now what the first collection has set free
    shelve(spark.read.schema(TOLD).parquet(plain), path)
    removed(spark, plain)
    parts = spark.read.schema(TOLD).parquet(path).select(F.explode("part").alias("p")).groupBy("p.context")
    return parts.agg(*[F.sum(f"p.{x}").alias(x) for x in ("size", "twice", "gain", "kinds", "stays")]).toArrow()  # HOT rows at most


def pieces_of(blocks: DataFrame, buckets: int) -> tuple[DataFrame, Level, dict]:
    """The texts as tokens, the answers for them, and tokens and kinds of the training texts."""
    spark, path, level = blocks.sparkSession, fresh_path(blocks.sparkSession, "lm-pieces"), fresh_path(blocks.sparkSession, "lm-level-0")
    schema = merged(ASKED, PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in blocks_of(batches):
            piece, asked = read(block, buckets, parts)
            yield batch_of([piece, *asked], schema)

    made = blocks.select("doc_id", "block", "row", "text", "learn").mapInArrow(lean(run), schema)
    made.withColumn("asks", F.col("bucket").isNotNull().cast("int")).write.partitionBy("asks").parquet(path)
    parts = told(spark.read.schema(schema).parquet(f"{path}/asks=1").select(*NAMES), level, numbered(buckets)) if rows_at(spark, f"{path}/asks=1") else None
    if parts is None:
        return spark.createDataFrame([], PIECES), Level(level, buckets, 0, 1, ()), {"tokens": 0, "kinds": 0}
    removed(spark, f"{path}/asks=1")
    dropped(spark)
    facts = {x: int(pc.sum(parts.column(y)).as_py() or 0) for x, y in (("tokens", "size"), ("kinds", "kinds"))}
    return spark.read.schema(PIECES).parquet(f"{path}/asks=0"), Level(level, buckets, 0, 1, ()), facts


def rows_at(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def grown(pieces: DataFrame, first: Level, facts: dict, bits: float = BITS) -> list[str]:
    """Folders of PLACES, of one length of contexts after the other, with the sums of places that the tree does not go on from."""
    spark, floor = pieces.sparkSession, facts["tokens"] + 0.5 * (facts["kinds"] + 1)
    buckets, much = max(64, facts["tokens"] // BUCKET_TOKENS), max(LEAST_HOT, facts["tokens"] // HOT)
    levels: list[Level] = []
    folders: list[str] = []
    schema = merged(ASKED, PLACES)
    stays = facts["tokens"]
    while True:
        depth, known, last = len(levels) + 1, list(levels), not stays
        before, keep = folders[-1] if folders else None, last or len(levels) >= ANEW
        if last and before:
            break

        def ask(batches: Iterator[pa.RecordBatch], known: list[Level] = known, depth: int = depth, before: str | None = before, keep: bool = keep, last: bool = last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    piece, kept = batch.slice(i, 1).to_pylist()[0], []
                    if before and not (kept := [r for r in shelved(before, piece["block"], [x.split()[0] for x in PLACES.split(", ")]) if r["n_at"]]):
                        continue
                    own = Block(piece, first.rows(piece["block"]), first.buckets)
                    more = {}
                    if kept:
                        own.resume(depth - 1, kept[0])
                        stood = own.at
                        own.follow(known[-1])
                    else:
                        own.start(floor, buckets)
                        own.walk(known, bits)
                        stood = np.arange(len(own.tokens))
                        total = lambda x: np.add.reduceat(x, own.begin[:-1])
                        more = {"known": packed(total((own.count > 0).astype(np.int64))), "base": packed(total(np.log10(own.base)))}
                    if last:
                        yield batch_of([{"block": own.name, "n_at": 0, "sums": packed(own.sums(stood)), **more}], schema)
                        continue
                    own.step(depth, bits, much)
                    if len(own.at):
                        yield batch_of(own.questions(buckets, depth), schema)
                    if keep:
                        gone = np.ones(len(own.tokens), dtype=bool)
                        gone[own.at] = False
                        yield batch_of([own.state(stood[gone[stood]]) | more], schema)

        path = fresh_path(spark, f"lm-level-{depth}")
        with few_rows(spark):
            asked = pieces.mapInArrow(lean(ask), schema)
            if keep:
                folders.append(fresh_path(spark, f"lm-places-{depth}"))
                shelve(asked, folders[-1])
                if last:
                    break
                asked = spark.read.schema(schema).parquet(folders[-1]).where("bucket IS NOT NULL")
            parts = told(asked.select(*NAMES), path, answered(bits, depth))
        del asked
        dropped(spark)
        stays = pc.sum(parts.column("stays")).as_py() or 0
        parts = parts.filter(pc.is_valid(parts.column("context")))
        context, size, twice, gain = (parts.column(x).to_numpy() for x in ("context", "size", "twice", "gain"))
        good = gains(size, twice, gain) >= bits
        levels.append(Level(path, buckets, much, max(1, facts["tokens"] // (4 * buckets)), tuple(x[good] for x in (context.view(U64), size, size - twice))))
        stays += int(good.sum())
    return folders


SCORED = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def scored(docs: DataFrame, bits: float = BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of (doc_id, text)."""
    blocks, buckets = placed(docs)
    pieces, first, facts = pieces_of(blocks, buckets)
    folders = grown(pieces, first, facts, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                kept = [r for x in folders for r in shelved(x, piece["block"], ["sums", "rest", "n_at", "known", "base"]) if r["sums"]]
                score = np.sum([unpacked(r["sums"], np.float64) for r in kept], axis=0)
                if kept[-1]["n_at"]:
                    score += unpacked(kept[-1]["rest"], np.float64)
                ids = pa.array(np.frombuffer(piece["doc_id"], np.int64), mask=unpacked(piece["no_id"]).astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(unpacked(piece["counts"])), pa.array(unpacked(kept[0]["known"])), pa.array(unpacked(kept[0]["base"], np.float64)), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    result = pieces.select("block", "doc_id", "no_id", "counts").mapInArrow(run, SCORED)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    return result.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(facts["tokens"]).cast("bigint").alias("train_tokens"), "base_score", "score")
