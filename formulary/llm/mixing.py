"""Mixing sources to target weights by systematic sampling.

A document of a source with target t and total size s is expected t / s times.
Within a source, documents stand in order of size (then of a hash bucket, then of
id); the expected copies up to each document are a prefix sum, one random offset
is added, and a document is emitted once for every integer that its stretch of
the sum crosses. In order of size, what a source gets differs from its target by
about one large document.

The prefix sum is distributed. Expected copies are constant within a source, so
the sum is the document's rank times t / s, and the rank is found along a path
source -> size range -> size -> bucket -> row. Each window's partition holds the
children of one node of that path only, so a source with a third of all rows is
ranked by many tasks. Only DataFrame functions are used, and texts are not shuffled.

Defined results: a null source is a source, last in order; a null or empty text
has size 0; a source of size 0 has target 0 and takes nothing; repeated rows are
documents of their own, also in ``mix``, which goes by rows; an empty table gives an empty result. The offset is a
hash of source and seed, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formulary.llm.storage import row_id, written

#: Weights of the sources, in order of code points; repeated for further sources.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the input.
SHARE = 1.5
#: A source's words may stand in the mix this many times at most.
REPEATS = 2.0
#: Sizes of one range.
RANGE = 1024


def words(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def hex_fraction(text: Column, digits: int = 8) -> Column:
    """The first hex digits of the MD5 of a text, as a fraction of one."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("double") / float(16**digits)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, repeats: float) -> DataFrame:
    """source, source_size, target from (source, source_size); one row for each source.

    Targets are min(repeats * size, level * weight), with the one level at which
    they sum to the share of all sizes. Sources whose limit is reached first come
    first; the level is what is left after them, by the weight of the others.
    """
    every = W.partitionBy(F.lit(1))
    place = F.row_number().over(every.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(repeats)))
    # Of the levels that the next source can take whole, the first is the highest, and the right one.
    order = every.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    left = F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1))
    still = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(every) * F.lit(float(share))
    level = (total - F.coalesce(left, F.lit(0.0))) / still
    free = weighed.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") < F.col("most") / F.col("weight"), F.col("level"))).over(every))
    target = F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return free.select("source", "source_size", target.alias("target"))


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, seed: str = "mix") -> DataFrame:
    """doc_id, rid (row_id of doc_id, source and text), source, size, source_size, target and copies (how often the document is emitted)."""
    identity = row_id("doc_id", "source", "text")
    # Texts are read once; what follows reads three narrow columns.
    own = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", words(F.col("text")).alias("size"), identity.alias("rid")), "sizes")
    bucket = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 3), 16, 10).cast("int")
    own = own.withColumn("range", F.floor(F.col("size") / RANGE)).withColumn("bucket", bucket)
    # A null source needs a key that joins.
    own = own.withColumn("key", F.struct(F.col("source").isNull().alias("absent"), F.coalesce("source", F.lit("")).alias("name")))
    path = ["key", "range", "size", "bucket"]
    counted = own.groupBy(*path).agg(F.count("*").alias("n"))

    before = None
    for depth in range(len(path), 1, -1):
        level = counted.groupBy(*path[:depth]).agg(F.sum("n").alias("n"))
        over = W.partitionBy(*path[: depth - 1]).orderBy(path[depth - 1]).rowsBetween(W.unboundedPreceding, -1)
        level = level.select(*path[:depth], F.coalesce(F.sum("n").over(over), F.lit(0)).alias(f"before_{depth}"))
        before = level if before is None else before.join(level, path[:depth])
    sources = own.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("source", F.when(~F.col("key.absent"), F.col("key.name")))
    aimed = targets(sources, weights, share, repeats).withColumn("key", F.struct(F.col("source").isNull().alias("absent"), F.coalesce("source", F.lit("")).alias("name"))).drop("source")

    rank = F.col("before_2") + F.col("before_3") + F.col("before_4") + F.row_number().over(W.partitionBy(*path).orderBy("doc_id"))
    placed = own.join(before, path).withColumn("rank", rank).join(aimed, "key")
    offset = hex_fraction(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("\u0001"))))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(F.col("rank") * expected + offset) - F.floor((F.col("rank") - 1) * expected + offset)
    return placed.select("doc_id", "rid", "source", "size", "source_size", "target", crossed.cast("bigint").alias("copies"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed corpus itself: each row as often as it is emitted, with a column ``copy`` from 1."""
    return emitted(docs, copies(docs, **parameters))


def emitted(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row as often as a plan made by copies() says; equal rows share theirs, numbered through."""
    taken = plan.groupBy("rid").agg(F.sum("copies").cast("int").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0").withColumnRenamed("rid", "_rid")
    copy = "copy" if "copy" not in docs.columns else "mix_copy"
    found = docs.join(taken, row_id("doc_id", "source", "text") == F.col("_rid"))
    found = found.where("_rows = 1").unionByName(found.where("_rows > 1").dropDuplicates(["_rid"]))
    return found.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias(copy))
