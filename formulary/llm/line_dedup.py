"""Near-duplicate lines by deletion neighbourhoods.

Lines are what stands between line feeds; their words are compared. Lines of
``min_words`` words or more are duplicates when one word inserted, deleted or
substituted makes them equal, whatever their length; shorter ones only when they
are equal, to each other: a line of ``min_words`` words is no duplicate of one with
a word less. A line stays only
if it is the earliest, by doc_id and line number, among its duplicates. Lines
without words stay.

1. Equal lines become one, with its earliest place.
2. Lines within the bound share their first or their last half; only lines that
   share a hashed half with another go on. This loses none.
3. Each of those emits its deletion neighbourhood: a hash of the line, and of the
   line without each of its words. The hashes come from running XORs over the
   words, so a line costs as many steps as it has words.
4. Equal keys are joined on minima, never in pairs: lines that are equal without
   the word at one place differ by one substitution; a line equal to another
   without some word differs by one insertion.
5. The edit distance of each line and the earliest neighbour found is verified.

Only DataFrame functions are used. A line that a third of all documents hold is
one row after step 1, which aggregates within tasks first.

Defined results: a null or empty text is one line without words; lines of rows
that repeat a doc_id stand at the same places, and stay or go together; rows
without a doc_id come first; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formulary.llm.storage import few, written

MIN_WORDS = 8
PLACE = ("doc_id", "line")


def tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line number from 0, and the words, of lines that have words."""
    split = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "content"))
    return split.select("doc_id", "line", tokens(F.col("content")).alias("words")).where(F.size("words") > 0)


def place() -> Column:
    return F.struct(*PLACE).alias("place")


def halves(words: Column, n: Column) -> Column:
    """Hashes of the halves that a line shares with lines as long, or shorter or longer by one word."""
    keys = []
    for less in (0, 1):  # cut as the shorter of the two is
        first = F.floor((n - less) / 2).cast("int")
        rest = (n - less - first).cast("int")
        keys.append(F.xxhash64(F.lit(0), n - less, F.slice(words, F.lit(1), first)))
        keys.append(F.xxhash64(F.lit(1), n - less, F.slice(words, n - rest + 1, rest)))
    return F.array(*keys)


def earliest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, line of every line with words that stays."""
    n = F.size("words")
    # A short line gives away only itself; the empty array of halves keeps it from step 2.
    keyed = lines(docs).select(*PLACE, F.xxhash64("words").alias("h"), F.xxhash64(F.lit(7), "words").alias("g"), n.alias("n"), F.when(n >= min_words, halves(F.col("words"), n)).alias("halves"))
    unique = written(keyed.groupBy("h", "g", "n").agg(F.min(F.struct(*PLACE, "halves")).alias("first")).select("first.doc_id", "first.line", "first.halves"), "lines-unique")

    shared = unique.where("halves IS NOT NULL").select(*PLACE, F.explode("halves").alias("half"))
    # Lines one word shorter than min_words have no halves; a longer neighbour is then no duplicate of theirs.
    several = shared.groupBy("half").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    survivors = written(shared.join(several, "half").select(*PLACE).distinct(), "lines-survivors")
    small = few(survivors)
    ids = survivors.select("doc_id").distinct()
    found = lines(docs.join(F.broadcast(ids) if small else ids, docs["doc_id"].cast("bigint").eqNullSafe(ids["doc_id"]), "left_semi"))
    match = survivors.select(F.col("doc_id").alias("d"), F.col("line").alias("l"))
    same = found["doc_id"].eqNullSafe(match["d"]) & (found["line"] == match["l"])
    texts = written(found.join(F.broadcast(match) if small else match, same, "left_semi").dropDuplicates([*PLACE]), "lines-texts")

    # The neighbourhood: XORs of (word, place) before the missing word, and of (word, place - 1) behind it.
    each = texts.select(*PLACE, F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    each = each.select(*PLACE, "n", "i", F.xxhash64("word", "i").alias("stay"), F.xxhash64("word", F.col("i") - 1).alias("move"))
    line = W.partitionBy(*PLACE)
    upto = line.orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    xor = lambda c, over: F.bit_xor(c).over(over)
    each = each.select(*PLACE, "n", "i", "stay", xor("stay", upto).alias("s"), xor("move", upto).alias("m"), xor("move", line).alias("all_m"), xor("stay", line).alias("whole"))
    each = each.select(place(), "n", "i", F.xxhash64(F.col("n") - 1, F.col("s").bitwiseXOR(F.col("stay")).bitwiseXOR(F.col("all_m")).bitwiseXOR(F.col("m"))).alias("key"), F.xxhash64("n", "whole").alias("whole"))
    variants = written(each, "lines-variants")
    wholes = variants.where("i = 0").select("place", F.col("whole").alias("key"))

    substituted = variants.join(variants.groupBy("key", "i").agg(F.min("place").alias("near"), F.count("*").alias("k")).where("k > 1"), ["key", "i"]).select("place", "near")
    longer = wholes.join(variants.groupBy("key").agg(F.min("place").alias("near")), "key").select("place", "near")
    shorter = variants.select("place", "key").join(wholes.groupBy("key").agg(F.min("place").alias("near")), "key").select("place", "near")
    near = substituted.unionByName(longer).unionByName(shorter).where("near < place").groupBy("place").agg(F.min("near").alias("near"))
    own = texts.select(place(), F.col("words").alias("a"))
    other = texts.select(place().alias("near"), F.col("words").alias("b"))
    dropped = near.join(own, "place").join(other, "near").where(within_one(F.col("a"), F.col("b"))).select("place.*")
    return unique.select(*PLACE).join(dropped, [unique["doc_id"].eqNullSafe(dropped["doc_id"]), unique["line"] == dropped["line"]], "left_anti")


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at an edit distance of one at most."""
    agree = lambda x, y: F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: F.coalesce(p["x"] == p["y"], F.lit(False)))
    front = lambda x, y: F.coalesce(F.nullif(F.array_position(agree(x, y), F.lit(False)), F.lit(0)) - 1, F.greatest(F.size(x), F.size(y)).cast("bigint"))
    fits = front(a, b) + front(F.reverse(a), F.reverse(b)) >= F.least(F.size(a), F.size(b)) - F.when(F.size(a) == F.size(b), 1).otherwise(0)
    return (F.abs(F.size(a) - F.size(b)) <= 1) & fits


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and the text of the lines that stay, for every row."""
    stay = earliest(docs, min_words).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("line").alias("_stay"))  # of one document
    all_lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    split = F.split("text", "\n")
    joined = all_lines.join(stay, all_lines["doc_id"].eqNullSafe(stay["_doc"]), "left")
    kept = F.filter(F.col("parts"), lambda x, i: ~x.rlike(r"[^\x20\x09-\x0D]") | F.coalesce(F.array_contains("_stay", i), F.lit(False)))
    out = joined.withColumn("parts", split).withColumn("kept", kept)
    return out.select("doc_id", F.size("parts").cast("bigint").alias("n_lines"), (F.size("parts") - F.size("kept")).cast("bigint").alias("n_removed"), F.array_join("kept", "\n").alias("text"))
