"""Connected components of an edge list, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulary.llm.storage import written


def star_step(edges: DataFrame) -> DataFrame:
    """One large star and one small star of edges (a, b) with a > b.

    A large star ties the larger neighbours of a node to the least of its
    neighbourhood, a small star the smaller ones and the node itself. Minima are
    aggregated, so a hub's neighbours are never gathered in one row.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return small.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node that has an edge in (a, b); label is the least node of the component."""
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, seen = written(ordered, "edges"), None
    while True:
        current = written(star_step(current), "edges")
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s"), F.count_distinct("a").alias("k")).first()
        # Stars only: every node has one edge, and another step changes nothing.
        if (state["n"], state["s"]) == seen:
            break
        seen = (state["n"], state["s"])
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
