"""Join of documents on the Jaccard similarity of their word shingles, by prefix trees.

Exact: no link between two texts is missed, and each is counted out in full.

1. A document's set is hashed; equal sets are one node from there on.
2. Lossless routing. Sizes fall into classes whose bounds grow by 1 / threshold,
   so that linked sets lie in one class or two neighbouring ones. For such a pair
   the symmetric difference has a greatest size d. The hash range is cut into more
   than d parts, so at least one part is equal in both. Each part's content, but
   for shingles known to be frequent, is a
   signature, and sets that share one become candidates. A task sorts and packs
   its signatures by ranges before the shuffle; beyond it, those that share one
   form a star, never pairs.
   There are so many parts that a part with something in it is shared, unless a
   set has exceptionally many empty parts; only such sets sign those too, by the
   frequent shingles in them, the least frequent first, else by their number.
3. Candidates form clusters. A cluster, or where it is large each pair of bounded
   pieces of it (by size class, then by hash), is a block for one task.
4. In a block the sets, with their n-grams in one common order (the more frequent
   in the block first), are stored in a path-compressed trie. All sets of the block
   walk down it together; what a shared path adds to their overlaps is added once
   for each edge. A subtree is left when the overlap so far and the most that can
   remain below it cannot reach the threshold, or when its sizes cannot.
5. Each block gives a spanning forest of its links; components of all forests are
   the result.

A group of copies is a node. A group of near copies gives a number of blocks that
grows with the square of (its size / UNIT_SETS) at worst, each of bounded memory.

Hashes have 64 bits; two sets are one node only if their sizes agree too.

Defined results: null and empty texts, and those without words, have an empty set
and are linked with nothing; with fewer words than a shingle, all words form one;
rows that repeat an id are documents of their own that share it; rows without an id
are linked as others are, and have the least id of their component, null where it
has none; an empty table gives an empty result; other columns of the input are
ignored. ``one_of_each`` goes by rows: of each component, and of rows that repeat
both id and text, one stays; rows without words all stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulary.llm import words
from formulary.llm.graph import components
from formulary.llm.storage import few, lean, released, row_id, without_rows, written

U64 = np.uint64
#: Sets and n-grams of a piece of a cluster at most (a longer set is a piece of its own).
UNIT_SETS = 512
UNIT_GRAMS = 1 << 17
#: Signatures that a task combines before it passes them on.
FLUSH = 1 << 19
#: Pairs of a row at most.
PAIRS = 1 << 12
#: A shingle of this many documents is left out of signatures; tasks pass it on from SEVERAL.
FREQUENT, SEVERAL, MOST_FREQUENT = 24, 3, 500_000
#: Frequent shingles are of level 1, and of one more for each time that they are so much more frequent.
STEP = 16
#: Bytes of text for each bucket of signatures; a bucket is held by one task at a time.
BUCKET_BYTES = 8 << 20
#: Members of clusters, seven numbers each, or clusters in pieces, that may be broadcast.
PLACED_ROWS = 200_000


@dataclass(frozen=True)
class Similarity:
    """Intersection / union of at least num / den."""

    num: int
    den: int

    def bounds(self, most: int) -> np.ndarray:
        """First size of each class, up to one beyond ``most``."""
        out = [1]
        while out[-1] <= most:
            out.append(out[-1] * self.den // self.num + 1)
        return np.array([*out, out[-1] * self.den // self.num + 1], dtype=np.int64)

    def least(self, sizes: np.ndarray) -> np.ndarray:
        """Intersection that sets with this sum of sizes need."""
        return -(-self.num * sizes // (self.num + self.den))


@cache
def scheme(like: Similarity, level: int) -> tuple[int, int]:
    """Number of parts of a level, and the number of empty parts from which a set signs them."""
    b = like.bounds(1)
    while len(b) < level + 2:
        b = like.bounds(int(b[-1]))
    most = int(b[level + 1]) - 1
    differ = (like.den - like.num) * 2 * most // (like.den + like.num)
    empty = (differ + 1) * np.exp(-float(b[max(0, level - 1)]) / (differ + 1))
    spare = int(np.ceil(empty + 4 * np.sqrt(empty)))
    return differ + 1 + spare, spare + 1


def gram_sets(batch: pa.RecordBatch, k: int, column: str = "text") -> list[np.ndarray]:
    """The sorted set of hashed k-word shingles of each row; words with A-Z lower-cased."""
    data, rows = words.flat(batch.column(column))
    data = words.LOWER[data]
    starts, ends, at = words.spans(data, rows)
    h = words.hashes(data, starts, ends)
    g = words.grams(h, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(words.mix(words.grams(h[a:b], b - a) + U64(b - a)))
        else:
            out.append(h[:0])
    return out


def node_ids(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([int(words.mix(np.add.reduce(words.mix(s), dtype=U64, keepdims=True) ^ U64(len(s)))[0]) if len(s) else 0 for s in sets], dtype=U64)


@dataclass(frozen=True)
class Frequent:
    """Sorted shingles that many documents hold, and the level of each."""

    grams: np.ndarray
    levels: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, n: np.ndarray) -> Frequent:
        order = np.argsort(grams)
        steps = np.log(np.maximum(n, FREQUENT) / FREQUENT) / np.log(STEP)
        return cls(grams[order], 1 + np.floor(steps[order]).astype(np.int64))

    def level(self, grams: np.ndarray) -> np.ndarray:
        """0 for shingles that are not frequent."""
        if not len(self.grams):
            return np.zeros(len(grams), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.levels[at], 0)


def frequent_grams(docs: DataFrame, k: int) -> Frequent:
    """Shingles that many documents hold; at most MOST_FREQUENT.

    Tasks count all their documents' shingles and pass on those that several hold.
    What is missed here only makes candidates more, never links fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            flat = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
            n = np.diff(np.r_[at, len(flat)])
            some = n >= SEVERAL
            return pa.RecordBatch.from_arrays([pa.array(flat[at][some].view(np.int64)), pa.array(n[some], pa.int64())], ["gram", "n"])

        for batch in batches:
            for part in words.text_slices(batch):
                held += gram_sets(part, k)
                size += sum(map(len, held[-part.num_rows :]))
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    found = docs.select("doc_id", "text").mapInArrow(lean(run), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    most = found.orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).toArrow()
    return Frequent.of(most.column("gram").to_numpy().view(U64), most.column("n").to_numpy())


def signatures(sets: list[np.ndarray], nodes: np.ndarray, like: Similarity, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """Signature and node of each part of each set, for its own class and the next.

    Frequent shingles are left out of the parts: two sets differ in no more places
    without them, so a part is still equal in both, and a passage that many
    documents share does not make candidates of them. A part is of the least level
    that its shingles have, and signed by those of that level. Beyond level 0 it is
    signed only if the set has more parts of its level or above, or empty, than a
    scheme can spare: of the equal parts of two linked sets, more than it can
    spare, all are then signed at the least level that any of them has, in both.
    """
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    if not len(full):
        return np.empty(0, U64), np.empty(0, U64)
    flat = np.concatenate([sets[i] for i in full])
    owner = np.repeat(np.arange(len(full)), sizes[full])
    level = frequent.level(flat)
    kinds = np.searchsorted(like.bounds(int(sizes.max())), sizes[full], side="right") - 1
    content = words.mix(flat + U64(0x51))
    top = flat >> U64(32)
    found = []
    for up in (0, 1):
        schemes = [scheme(like, int(x) + up) for x in kinds]
        parts, many = np.array([n for n, _ in schemes], dtype=U64), np.array([n for _, n in schemes])
        part = (top * parts[owner]) >> U64(32)
        runs = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])])
        of = owner[runs]
        label = words.mix(((kinds + up).astype(U64)[of] << U64(40)) + part[runs])
        least = np.minimum.reduceat(level, runs)
        own = level == np.repeat(least, np.diff(np.r_[runs, len(part)]))
        signed = words.mix(np.add.reduceat(np.where(own, content, U64(0)), runs) ^ label)
        some = least == 0
        for x in range(1, int(least.max()) + 1):
            lean = parts.astype(np.int64) - np.bincount(of[least < x], minlength=len(full)) >= many
            some |= (least == x) & lean[of]
        found.append((signed[some], nodes[full][of[some]]))
        for i in np.flatnonzero(parts.astype(np.int64) - np.bincount(of, minlength=len(full)) >= many):
            a, b = np.searchsorted(of, [i, i + 1])
            rest = np.setdiff1d(np.arange(int(parts[i]), dtype=U64), part[runs[a:b]])
            found.append((words.mix(words.mix((U64(kinds[i] + up) << U64(40)) + rest)), np.full(len(rest), nodes[full[i]], U64)))
    return np.concatenate([s for s, _ in found]), np.concatenate([n for _, n in found])


ROUTED = "bucket int, base bigint, width int, sigs binary, places binary, nodes binary, doc_ids array<bigint>, sizes array<bigint>, doc_nodes array<bigint>, rids array<bigint>"


def routed(docs: DataFrame, k: int, like: Similarity, buckets: int, frequent: Frequent) -> DataFrame:
    """Three kinds of rows: documents with their nodes and sizes; pairs of nodes that share a signature
    within a task, in the last two columns; and a task's signatures of one bucket, packed.

    A bucket is a range of signatures. They are sorted, so that their differences
    take few bytes, and each has the place of its node in the row's list of nodes.
    """
    told_frequent = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            for part in words.text_slices(batch):
                sets = gram_sets(part, k)
                nodes = node_ids(sets)
                held.append(signatures(sets, nodes, like, told_frequent.value))
                count += len(held[-1][0])
                told = [[spread(part.column("rid").to_numpy().view(U64), buckets)], [0], [0], [b""], [b""], [b""], [part.column("doc_id").to_pylist()], [[len(s) for s in sets]], [nodes.view(np.int64).tolist()], [part.column("rid").to_pylist()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(told, TYPES, strict=True)], NAMES)
                if count >= FLUSH:
                    yield packed(held, buckets)
                    held, count = [], 0
                    released()
        if count:
            yield packed(held, buckets)

    return docs.mapInArrow(lean(run), ROUTED)


NAMES = ["bucket", "base", "width", "sigs", "places", "nodes", "doc_ids", "sizes", "doc_nodes", "rids"]
TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]


def bucket_of(sig: np.ndarray, buckets: int) -> np.ndarray:
    return ((sig >> U64(32)) * U64(buckets)) >> U64(32)


def spread(content: np.ndarray, buckets: int) -> int:
    """A bucket for a row that any task may have, by all that is in it: rows with something in common do not meet."""
    return int(words.mix(np.add.reduce(words.mix(content), dtype=U64, keepdims=True))[0] % U64(buckets))


def packed(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    sig, node = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
    sig, node = sig[new], node[new]
    # Within the task a signature's nodes form a star already; only the least goes further.
    first = np.r_[True, sig[1:] != sig[:-1]]
    least = node[np.flatnonzero(first)][np.cumsum(first) - 1]
    tied = np.unique(np.stack([node[~first], least[~first]], axis=1), axis=0)
    sig, node = sig[first], node[first]
    bucket = bucket_of(sig, buckets)
    cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(sig)]
    rows = []
    for a in range(0, len(tied), PAIRS):
        some = tied[a : a + PAIRS]
        rows.append((spread(some.ravel(), buckets), 0, 0, b"", b"", b"", None, *some.view(np.int64).T, None))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        nodes, place = np.unique(node[a:b], return_inverse=True)
        step = np.diff(sig[a:b], prepend=sig[a])
        width = max(1, (int(step.max()).bit_length() + 7) // 8)
        raw = step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        rows.append((int(bucket[a]), int(sig[a].view(np.int64)), width, raw, place.astype("<u2" if len(nodes) <= 1 << 16 else "<u4").tobytes(), nodes.tobytes(), None, None, None, None))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)


def unpacked(base: int, width: int, sigs: bytes, places: bytes, nodes: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(sigs) // width
    step = np.zeros((n, 8), dtype=np.uint8)
    step[:, :width] = np.frombuffer(sigs, dtype=np.uint8).reshape(n, width)
    sig = np.cumsum(step.reshape(-1).view("<u8"), dtype=U64) + np.int64(base).view(U64)
    return sig, np.frombuffer(nodes, dtype=U64)[np.frombuffer(places, dtype=f"<u{len(places) // n}")]


def stars(rows: DataFrame) -> DataFrame:
    """doc_id, n, node of every document, and (a, b) of every node that shares a signature: with the least that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        bucket = None

        def flush() -> pa.RecordBatch:
            sig, node = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(sig, kind="stable")
            sig, node = sig[order], node[order]
            same = np.r_[False, sig[1:] == sig[:-1]]
            some = same | np.r_[same[1:], False]
            sig, node, same = sig[some], node[some], same[some]
            if not len(sig):
                return pairs(sig, sig)
            at = np.flatnonzero(~same)
            least = np.repeat(np.minimum.reduceat(node, at), np.diff(np.r_[at, len(sig)]))
            both = np.stack([node, least], axis=1)[node != least]
            both = np.unique(both, axis=0)
            return pairs(both[:, 0], both[:, 1])

        for batch in batches:
            told, listed = pc.is_valid(batch.column("doc_ids")), pc.is_valid(batch.column("sizes"))
            own = [batch.filter(told).column(c).flatten() for c in ("doc_ids", "rids", "sizes", "doc_nodes")]
            yield pa.RecordBatch.from_arrays(own + [pa.nulls(len(own[0]), pa.int64())] * 2, STARS)
            tied = batch.filter(pc.and_not(listed, told))
            yield pairs(*(tied.column(c).flatten().to_numpy() for c in ("sizes", "doc_nodes")))
            for row in batch.filter(pc.invert(listed)).select(NAMES[:6]).to_pylist():
                if row["bucket"] != bucket and held:
                    yield flush()
                    held = []
                bucket = row["bucket"]
                held.append(unpacked(*(row[c] for c in NAMES[1:6])))
        if held:
            yield flush()

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "doc_id bigint, rid bigint, n bigint, node bigint, a bigint, b bigint")


STARS = ["doc_id", "rid", "n", "node", "a", "b"]


def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64())] * 4 + [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], STARS)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def trie_links(sets: list[np.ndarray], sides: np.ndarray | None, like: Similarity) -> Forest:
    """Joins the sets of a block that are linked; with sides, only across them."""
    forest = Forest(len(sets))
    sizes = np.array([len(s) for s in sets])
    grams, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A gram of one set alone adds to no overlap; it counts in the sizes only.
    order = np.lexsort((grams, -counts))
    order = order[: int((counts > 1).sum())]
    rank = np.full(len(grams), -1, dtype=np.int64)
    rank[order] = np.arange(len(order))
    ranks, cuts = rank[inverse], np.r_[0, np.cumsum(sizes)]
    paths = [np.sort(r[r >= 0]) for r in (ranks[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
    rows = sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes())
    paths, sizes = [paths[i] for i in rows], sizes[rows]
    length = np.array([len(p) for p in paths])
    side = None if sides is None else np.asarray(sides)[rows]
    has = np.zeros((len(rows), max(1, len(order))), dtype=bool)
    for i, p in enumerate(paths):
        has[i, p] = True
    common = np.zeros(len(rows), dtype=np.int64)  # length of the path shared with the row before
    for i in range(1, len(rows)):
        n = min(length[i], length[i - 1])
        apart = np.flatnonzero(paths[i][:n] != paths[i - 1][:n])
        common[i] = apart[0] if len(apart) else n

    # A node: rows lo..hi share a path down to its depth. Rows that go on from there are its children.
    stack = [(0, len(rows), 0, np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64))]
    while stack:
        lo, hi, depth, active, overlap = stack.pop()
        below = int(common[lo + 1 : hi].min()) if hi - lo > 1 else int(length[lo])
        if below > depth:
            overlap = overlap + has[np.ix_(active, paths[lo][depth:below])].sum(axis=1)
        low, high = sizes[lo:hi].min(), sizes[lo:hi].max()
        own = sizes[active]
        able = (overlap + (length[lo:hi].max() - below) >= like.least(own + low)) & (own * like.num <= high * like.den) & (low * like.num <= own * like.den) & (active > lo)
        active, overlap = active[able], overlap[able]
        if not len(active):
            continue
        if hi - lo == 1 or below == length[lo:hi].max():
            # What ends here has this overlap. Rows with the same path follow one another.
            for leaf in range(lo, hi):
                hit = active[(active > leaf) & (overlap >= like.least(sizes[active] + sizes[leaf]))]
                if side is not None:
                    hit = hit[side[hit] != side[leaf]]
                for q in hit.tolist():
                    forest.join(rows[q], rows[leaf])
            continue
        starts = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == below)).tolist(), hi]
        stack += [(a, b, below, active, overlap) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return forest


def block_links(blocks: DataFrame, like: Similarity) -> DataFrame:
    """(a, b): a spanning forest of the links of each block."""

    def solved(rows: list[dict]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(r["grams"], dtype=U64) for r in rows]
        sides = [r["side"] for r in rows]
        forest = trie_links(sets, np.array(sides) if len(set(sides)) > 1 else None, like)
        return [(rows[i]["node"], rows[j]["node"]) for i in range(len(rows)) if (j := forest.root(i)) != i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if held and held[0]["block"] != row["block"]:
                    found += solved(held) if len(held) > 1 else []
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        if len(held) > 1:
            found = solved(held)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return blocks.select("block", "side", "node", "grams").repartition("block").sortWithinPartitions("block").mapInArrow(lean(run), "a bigint, b bigint")


def blocks(docs: DataFrame, members: DataFrame, k: int, like: Similarity) -> DataFrame:
    """block, side, node, grams: every set of a cluster, in each block that needs it.

    members: node, rid (of one row that has the set), n, cluster.
    """
    bounds = like.bounds(1 << 40)
    kind = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= F.col("n"))) - 1
    members = members.withColumn("kind", kind)
    pieces = members.groupBy("cluster", "kind").agg(F.count("*").alias("sets"), F.sum("n").alias("grams"))
    pieces = pieces.withColumn("pieces", F.ceil(F.greatest(F.col("sets") / UNIT_SETS, F.col("grams") / UNIT_GRAMS)).cast("int"))
    clusters = pieces.groupBy("cluster").agg(  # at most one entry for each class
        F.map_from_entries(F.collect_list(F.struct("kind", "pieces"))).alias("pieces"),
        ((F.sum("sets") <= UNIT_SETS) & (F.sum("grams") <= UNIT_GRAMS)).alias("whole"),
    )
    # Only clusters of several pieces need to be known: one in UNIT_SETS sets at most, but for very long ones.
    large = written(clusters.where(~F.col("whole")).select("cluster", "pieces"), "near-large")
    number = lambda step: F.coalesce(F.element_at("pieces", F.col("kind") + step), F.lit(0))
    placed = members.join(F.broadcast(large) if few(large, PLACED_ROWS) else large, "cluster", "left")
    placed = placed.select("rid", "node", F.col("cluster").alias("c"), "kind", number(0).alias("here"), number(1).alias("above"), number(-1).alias("below"))
    placed = written(placed, "near-members")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.text_slices(batch):
                sets = gram_sets(part, k)
                nodes = node_ids(sets).view(np.int64)
                # Hashes of rows may clash.
                right = np.flatnonzero(nodes == part.column("node").to_numpy())
                told = zip(*(part.column(c).to_numpy()[right].tolist() for c in ("c", "kind", "here", "above", "below")), strict=True)
                yield from block_rows((sets[i], int(nodes[i]), row) for i, row in zip(right.tolist(), told, strict=True))

    joined = docs.join(F.broadcast(placed) if few(placed, PLACED_ROWS) else placed, "rid").select("text", *placed.columns[1:])
    return joined.mapInArrow(lean(read), "block string, side int, node bigint, grams binary")


def block_rows(placed: Iterator[tuple[np.ndarray, int, tuple]]) -> Iterator[pa.RecordBatch]:
    """Rows of sets, with their nodes and where their clusters' pieces are, in all their blocks.

    In a large cluster a set is in as many blocks as there are pieces, so bytes bound a batch, not sets.
    """
    held: list[tuple[str, int, int, bytes]] = []
    size = 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["block", "side", "node", "grams"])
    for grams, node, row in placed:
        raw = grams.tobytes()
        for block, side in places(*row, node % (1 << 64)):
            held.append((block, side, node, raw))
            size += len(raw)
            if size >= words.SLICE_BYTES:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def places(cluster: int, kind: int, here: int, above: int, below: int, node: int) -> Iterator[tuple[str, int]]:
    """Blocks of a set, and its side in each: with every piece of its own class and of the neighbouring ones."""
    if not here:  # the whole cluster is one block
        yield str(cluster), 0
        return
    own = node % here
    yield from ((f"{cluster}:{kind}:{min(own, x)}:{kind}:{max(own, x)}", int(own > x)) for x in range(here))
    yield from ((f"{cluster}:{kind}:{own}:{kind + 1}:{x}", 0) for x in range(above))
    yield from ((f"{cluster}:{kind - 1}:{x}:{kind}:{own}", 1) for x in range(below))


def classes(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of (doc_id, text); links need similarity num / den."""
    found = rows(docs, k, num, den)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, rid (row_id of id and text), n, component_id (null without words, or without any id), keeper (rid of the row that stays)."""
    like = Similarity(num, den)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("rid", row_id("doc_id", "text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kept = written(stars(routed(docs, k, like, max(1, size // BUCKET_BYTES), frequent_grams(docs, k))), "near-routed")
    own = kept.where("a IS NULL").select("doc_id", "rid", "n", "node")
    candidates = kept.where("a IS NOT NULL").select("a", "b")
    clusters = components(candidates)
    members = own.where("n > 0").groupBy("node", "n").agg(F.min("rid").alias("rid")).join(clusters, "node").withColumnRenamed("label", "cluster")
    links = written(block_links(blocks(docs, members, k, like), like), "near-links")
    linked = components(links)

    # Node to component, by the least document of either; nulls come last. A set is a node with its size.
    first = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "rid")
    nodes = own.where("n > 0").groupBy("node", "n").agg(F.min(first).alias("least")).join(linked, "node", "left")
    least = nodes.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("of_label"))
    named = nodes.join(least, "label", "left").select("node", "n", F.coalesce("of_label", "least").alias("of"))
    return own.join(named, ["node", "n"], "left").select("doc_id", "rid", "n", F.col("of.doc_id").alias("component_id"), F.col("of.rid").alias("keeper"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, one of each class."""
    found = written(rows(docs, k, num, den).where("n > 0").select(F.col("rid").alias("key"), "keeper"), "near-rows")
    gone = written(found.where("key <> keeper").select("key").distinct(), "near-dropped")
    repeated = written(found.where("key = keeper").groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "near-repeated")
    return without_rows(docs, gone, repeated, F.xxhash64(F.lit(1), F.col("doc_id").cast("bigint"), "text"))
