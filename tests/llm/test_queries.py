"""The registered queries on the smallest tables, against SQL, brute force or held-out labels."""

from __future__ import annotations

import math
from pathlib import Path

import brute
import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from formulary.llm import quality, queries, token_counts
from formulary.llm.storage import table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def plain(spark):
    return [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(float(f"{r[i]:.9g}") if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sql, name):
    df = queries.queries()[name](spark, FOLDER)
    want = sql.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert comparable(df.columns, df.collect()) == comparable(names, want.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_mix_is_near_its_targets(spark):
    df = queries.queries()["op2_mixing"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "source"), "doc_id")
    by = df.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert all(r["target"] <= 2 * r["size"] and r["most"] <= 2 for r in by)
    assert sum(abs(r["taken"] - r["target"]) for r in by) < 0.03 * sum(r["target"] for r in by)


def test_ngram_join(spark, plain):
    assert {tuple(r) for r in queries.queries()["op3_ngram_join"](spark, FOLDER).collect()} == brute.near_classes(plain, 3, 9, 10)


def test_substring_dedup(spark, plain):
    import hashlib

    want = sorted((d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute.without_repeats(plain, 35))
    assert sorted(tuple(r) for r in queries.queries()["op5_substring_dedup"](spark, FOLDER).collect()) == want


def test_token_counts(spark, plain):
    encode = token_counts.encoder(token_counts.VOCABULARY).encode_ordinary
    assert sorted(tuple(r) for r in queries.queries()["op7_token_counts"](spark, FOLDER).collect()) == sorted((d, len(encode(x))) for d, x in plain)


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    found = queries.queries()["op8_quality"](spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out")
    right, good, bad = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("predicted"))), F.avg(F.when(F.col("quality") == 0, 1 - F.col("predicted")))).first()
    assert right > 0.97 and good > 0.99 and bad > 0.88


def test_language_model_beats_its_base_on_held_out_texts(spark):
    found = queries.queries()["op9_suffix_tree_lm"](spark, "/root/testdata/sf0.01").groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).collect()
    assert all(math.isfinite(r["s"]) for r in found)
    held = next(r for r in found if r["held_out"])
    assert held["s"] > held["b"]


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    benchmark = [tuple(r) for r in table(spark, FOLDER, "benchmark").collect()]
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = ([tuple(r) for r in before.select("doc_id", "text").collect()], {r[0] for r in docs.select("doc_id").collect()})
    given, left = kept["quality classifier"]
    scores = {r["doc_id"]: r["score"] for r in quality.scored(table(spark, FOLDER, "documents"), quality.fit(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))).collect()}
    assert left == {d for d, _ in given if scores[d] >= quality.ACCEPT}
    given, left = kept["exact dedup"]
    least = {}
    for d, x in given:
        least[brute.lowered(x)] = min(d, least.get(brute.lowered(x), d))
    assert left == set(least.values())
    given, left = kept["n-gram Jaccard join"]
    assert left == {c for _, _, c in brute.near_classes(given, 5, 4, 5)}
    given, left = kept["benchmark decontamination"]
    assert left == {d for d, x in given if not brute.leaks(x, [b for _, b in benchmark], 12, 1)}
    given, left = kept["mixing"]
    assert left == {d for d, _ in given}


def test_pipeline_on_odd_rows(spark):
    """Nulls in any column, repeated rows and ids, an empty table, and columns that clash with inner names."""
    base = table(spark, FOLDER, "documents").withColumn("digest", F.lit(1)).withColumn("rid", F.lit(2)).withColumn("_key", F.lit(3))
    blank = base.limit(3).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("bigint").alias("n_chars"), "digest", "rid", "_key")
    odd = base.unionByName(base.limit(5)).unionByName(blank).unionByName(base.limit(5).withColumn("doc_id", F.lit(None).cast("bigint"))).unionByName(base.limit(5).withColumn("text", F.concat("text", F.lit(" more words of its own"))))
    for docs, empty in ((base.where("false"), True), (odd, False)):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, corpus_pipeline.written(stage(spark, docs, FOLDER), "odd")
            if name != "mixing":
                assert docs.columns == base.columns
            assert docs.isEmpty() == empty
            if name == "exact dedup":
                assert docs.count() == docs.select(F.lower(F.coalesce("text", F.lit("")))).distinct().count()
        assert docs.count() == before.count()


def test_pipeline_carries_out_its_mix(spark):
    """Each document stands in the result, with its columns, as often as the last stage's plan takes it."""
    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
    plan = {r["doc_id"]: r["copies"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()}
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    assert {0, 1, 2} >= set(plan.values()) > {1}
    assert sorted((r["doc_id"], r["copy"]) for r in found.collect()) == sorted((d, i + 1) for d, n in plan.items() for i in range(n))
