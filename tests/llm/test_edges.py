"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from formulary.llm import decontaminate, exact_dedup, line_dedup, mixing, near_dedup, quality, storage, substring_dedup, suffix_tree_lm, token_counts, warc

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
SOME = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
#: doc_id, text, source: repeated rows, equal texts, nulls, blanks, a very long text.
ROWS = [
    (1, SOME, "a"), (2, SOME.upper(), "a"), (3, None, None), (4, "", "b"), (5, "  \n\t ", "b"), (6, LONG, "c"), (7, LONG + " end", "c"),
    (8, "one", None), (8, "one", None), (9, "one", "a"), (10, "É é ß", "a"), (11, "x y", "b"), (12, SOME + " more", "a"), (None, "without id", "a"),
]
DOCS = "doc_id bigint, text string, source string"
#: Names that operators use within; they must neither clash nor get lost.
EXTRA = ("digest", "keep_id", "kept", "n", "place", "node", "words", "seed", "score", "size", "rank", "key", "_quality", "rid", "copy", "line", "label")


def wide(df):
    for i, name in enumerate(EXTRA):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(i))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return wide(spark.createDataFrame(ROWS, DOCS)).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_exact_dedup(docs, nothing):
    found = {r["doc_id"]: r for r in exact_dedup.dedup(docs, "largest").collect()}
    assert exact_dedup.dedup(docs, "largest").count() == len(ROWS)
    assert found[1]["keep_id"] == found[2]["keep_id"] == 2 and not found[1]["kept"] and found[2]["kept"]
    assert {found[i]["keep_id"] for i in (3, 4)} == {4} and found[5]["keep_id"] == 5
    assert found[8]["group_size"] == 3 and found[8]["keep_id"] == 9
    assert found[10]["keep_id"] == 10  # only A-Z are lower-cased
    assert exact_dedup.dedup(nothing).count() == 0
    left = exact_dedup.without_copies(docs, "smallest")
    assert left.columns == docs.columns and {r[0] for r in left.select("doc_id").collect()} == {1, 3, 5, 6, 7, 8, 10, 11, 12, None}


def test_exact_dedup_verifies_bytes(spark, docs):
    """With digests of one byte or none, different texts meet, and are told apart."""
    many = spark.createDataFrame([(i, f"text {i % 150}") for i in range(600)], "doc_id bigint, text string").repartition(7)
    for size in (0, 1):
        found = exact_dedup.dedup(many, "smallest", digest_bytes=size)
        assert rows(found.select("doc_id", "keep_id", "group_size")) == sorted(((i, i % 150, 4) for i in range(600)), key=str)


def test_exact_dedup_flushes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 5)
    monkeypatch.setattr(exact_dedup.Memtable, "full", lambda self: self.rows >= 5)
    many = spark.createDataFrame([(i, f"T{i % 20}") for i in range(200)], "doc_id bigint, text string").coalesce(1)
    assert rows(exact_dedup.dedup(many, "largest").select("doc_id", "keep_id")) == sorted(((i, 180 + i % 20) for i in range(200)), key=str)


def test_mixing(docs, nothing):
    found = mixing.copies(docs)
    assert found.count() == len(ROWS)
    assert found.where("copies < 0 OR copies > 2").count() == 0
    by = {r["source"]: r for r in found.groupBy("source").agg(F.max("target").alias("t"), F.max("source_size").alias("s")).collect()}
    assert set(by) == {"a", "b", "c", None} and by["b"]["s"] == 2
    assert abs(sum(r["t"] for r in by.values()) - 1.5 * sum(r["s"] for r in by.values())) < 1e-6
    assert mixing.copies(nothing).count() == 0
    assert rows(found) == rows(mixing.copies(docs.repartition(2)))
    mixed = mixing.mix(docs.where("doc_id <> 8"))
    assert mixed.columns == [*docs.columns, "mix_copy"]
    assert mixed.count() == mixing.copies(docs.where("doc_id <> 8")).agg(F.sum("copies")).first()[0]


def test_rows_without_an_id_or_with_the_same_one(spark):
    """What is dropped, kept or repeated is a row, not all rows of an id."""
    make = lambda data: wide(spark.createDataFrame(data, "doc_id bigint, text string, source string"))
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    found = exact_dedup.dedup(make([(None, "x", "a"), (3, "X", "a"), (None, "x", "b"), (None, "y", "a"), (None, "y", "a")]).coalesce(1), "largest").collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in found) == [("3", "3", 3, True), ("None", "3", 3, False), ("None", "3", 3, False), ("None", "None", 2, True), ("None", "None", 2, True)]
    data = [(5, "x", "a"), (5, "y", "a"), (3, "x", "a"), (7, "z", "a"), (7, "z", "b"), (None, "Z", "a"), (None, "q", "a"), (None, None, "a"), (8, "", "a")]
    assert texts(exact_dedup.without_copies(make(data))) == sorted([(5, "y"), (3, "x"), (7, "z"), (None, "q"), (8, "")], key=str)
    b = SOME
    data = [(None, b, "a"), (None, b + " z", "a"), (4, b + " q", "a"), (4, LONG, "a"), (9, LONG, "a"), (9, b, "a"), (None, "", "a"), (11, "k l", "a"), (11, "k l", "a")]
    found = near_dedup.classes(make(data), 3, 9, 10)
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found.collect()) == sorted([("None", "4"), ("None", "4"), ("4", "4"), ("4", "4"), ("9", "4"), ("9", "4"), ("None", "None"), ("11", "11"), ("11", "11")])
    assert texts(near_dedup.one_of_each(make(data), k=3, num=9, den=10)) == sorted([(4, b + " q"), (4, LONG), (None, ""), (11, "k l")], key=str)
    items = spark.createDataFrame([(1, SOME), (2, None)], "item_id bigint, text string")
    data = [(5, "see " + SOME, "a"), (5, "clean", "a"), (None, SOME, "a"), (None, "fine", "a")]
    assert texts(decontaminate.clean(make(data), items)) == [(5, "clean"), (None, "fine")]
    assert [tuple(r) for r in decontaminate.overlaps(make(data), items).collect()] == [(5, 1, len(SOME.split()))]
    data = [(5, "a b c", "a"), (5, "d e", "a"), (None, "f g", "a"), (None, "f g", "a"), (6, "h", "b")]
    plan = mixing.copies(make(data))
    mixed = mixing.emitted(make(data), plan)
    count = lambda df, n: {(r[0], r[1]): r[2] for r in df.groupBy("doc_id", n).agg(F.count("*") if n == "text" else F.sum("copies")).collect()}
    assert mixed.count() == plan.agg(F.sum("copies")).first()[0]
    by_text = count(mixed, "text")
    assert by_text.get((None, "f g"), 0) == sum(r["copies"] for r in plan.where("doc_id IS NULL").collect())
    for (d, x), n in by_text.items():
        assert n <= 2 * sum(1 for r in data if r[:2] == (d, x))


def test_archives_and_blocks_are_many_tasks(spark, monkeypatch):
    """A table of a few bytes for each file or block is not put together in one task."""
    monkeypatch.setattr(warc, "FILE_BYTES", 1)
    pages = spark.range(64).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    folder = warc.fresh_path(spark, "many")
    records = warc.written(warc.written_archives(pages, folder), "many-records")
    files = warc.normalised(records, folder).withColumn("task", F.spark_partition_id()).collect()
    assert len(files) >= 4 and len({r["task"] for r in files}) > len(files) // 4
    blocks = token_counts.scanned(spark.createDataFrame([], "file string, tokens bigint"), folder, 7, 4)
    assert blocks.count() == 0


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_near_dedup(docs, nothing, k, num, den):
    known = docs.where("doc_id IS NOT NULL")
    plain = [r[:2] for r in ROWS if r[0] is not None]
    assert set(rows(near_dedup.classes(known, k, num, den))) == brute.near_classes(plain, k, num, den)
    assert near_dedup.classes(docs, k, num, den).count() == len(ROWS)
    assert near_dedup.classes(nothing, k, num, den).count() == 0
    assert near_dedup.one_of_each(docs, k=k, num=num, den=den).columns == docs.columns


@pytest.mark.parametrize(("k", "num", "den", "units", "grams"), [(3, 9, 10, 512, 1 << 17), (5, 4, 5, 4, 1 << 17), (1, 1, 2, 512, 300)])
def test_near_dedup_groups(spark, monkeypatch, k, num, den, units, grams):
    """Chains and groups of near copies, in one block and in many."""
    monkeypatch.setattr(near_dedup, "UNIT_SETS", units)
    monkeypatch.setattr(near_dedup, "UNIT_GRAMS", grams)
    monkeypatch.setattr(near_dedup, "FREQUENT", 3)
    draw = random.Random(k)
    plain = []
    for group in range(6):
        base = [f"g{group}w{draw.randrange(500)}" for _ in range(draw.choice((3, 12, 60, 200)))]
        for _ in range(25):
            w = list(base)
            for _ in range(draw.randrange(0, max(2, len(w) // 12))):
                w[draw.randrange(len(w))] = f"n{draw.randrange(9999)}"
            plain.append((len(plain), " ".join(w)))
            base = w if draw.random() < 0.3 else base
    found = near_dedup.classes(spark.createDataFrame(plain, "doc_id bigint, text string").repartition(3), k, num, den)
    assert set(rows(found)) == brute.near_classes(plain, k, num, den)


def test_near_dedup_spreads_pairs():
    """Pairs that tasks find go out in rows of bounded length and to all buckets, not to the task of the first one."""
    draw = np.random.default_rng(3)
    load = np.zeros(64, dtype=np.int64)
    for _ in range(20):
        sig, node = np.repeat(draw.integers(0, 1 << 64, 20_000, dtype=np.uint64), 2), draw.integers(0, 1 << 64, 40_000, dtype=np.uint64)
        own = [r for r in near_dedup.packed([(sig, node)], 64).to_pylist() if r["sizes"] is not None]
        found = {(x % (1 << 64), y % (1 << 64)) for r in own for x, y in zip(r["sizes"], r["doc_nodes"], strict=True)}
        assert found == {(max(x), min(x)) for x in node.reshape(-1, 2).tolist()} and max(len(r["sizes"]) for r in own) <= 1 << 12
        np.add.at(load, [r["bucket"] for r in own], [len(r["sizes"]) for r in own])
    assert load.max() < 0.1 * load.sum() and (load > 0).sum() > 32


def test_near_dedup_bounds_batches_of_large_clusters():
    """A set of a cluster of many pieces is in many blocks; a batch holds so many bytes all the same."""
    sets = [np.arange(i, i + 20_000, dtype=np.uint64) for i in range(3)]
    batches = list(near_dedup.block_rows((s, -1 - i, (7, 4, 50, 30, 20)) for i, s in enumerate(sets)))
    found = [r for b in batches for r in b.to_pylist()]
    assert max(b.nbytes for b in batches) < 2 << 20
    for i, s in enumerate(sets):
        own = [r for r in found if r["node"] == -1 - i]
        assert len({r["block"] for r in own}) == len(own) == 100 and {r["grams"] for r in own} == {s.tobytes()}
        assert f"7:4:{(2**64 - 1 - i) % 50}:5:0" in {r["block"] for r in own}


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
@pytest.mark.parametrize("shared", [0, 60])
def test_near_dedup_keeps_candidates_of_unrelated_groups_apart(num, den, shared):
    """Groups of near copies whose shingles are frequent, with and without a passage that all groups hold."""
    draw = np.random.default_rng(7)
    passage = draw.integers(0, 1 << 64, shared, dtype=np.uint64)
    sets, group = [], []
    for g in range(40):
        common = np.r_[passage, draw.integers(0, 1 << 64, 300, dtype=np.uint64)]
        for i in range(30):
            differ = 1 + i % 12
            sets.append(np.sort(np.r_[draw.permutation(common)[differ:], draw.integers(0, 1 << 64, differ, dtype=np.uint64)]))
            group.append(g)
    grams, n = np.unique(np.concatenate(sets), return_counts=True)
    like, nodes = near_dedup.Similarity(num, den), np.arange(len(sets), dtype=np.uint64)
    sig, node = near_dedup.signatures(sets, nodes, like, near_dedup.Frequent.of(grams[n >= near_dedup.FREQUENT], n[n >= near_dedup.FREQUENT]))
    forest, first = near_dedup.Forest(len(sets)), {}
    for s, x in zip(sig.tolist(), node.tolist(), strict=True):
        forest.join(first.setdefault(s, x), x)
    held = [set(sig[node == x].tolist()) for x in nodes]
    for i in range(0, len(sets), 7):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                assert held[i] & held[j]
    clusters = {}
    for x in range(len(sets)):
        clusters.setdefault(forest.root(x), set()).add(group[x])
    assert all(len(groups) == 1 for groups in clusters.values())


def test_line_dedup(spark, docs, nothing):
    assert line_dedup.dedup(docs).count() == len(ROWS)
    assert line_dedup.dedup(nothing).count() == 0
    base = "the quick brown fox jumps over the lazy dog again"
    lines = [base, base.replace("quick", "slow"), base + " and", base.replace(" lazy", ""), "short line", "short line", "short lines", "", " ", base.replace("quick", "slow").replace("fox", "cat"), "fox " + base]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, base + "\nnew"), (3, None)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in line_dedup.dedup(df).collect()}
    # The line with two words changed is near a line that itself went; the earliest neighbour still counts.
    assert found[1]["text"].split("\n") == [base, "short line", "short lines", "", " "] and found[1]["n_lines"] == 11
    assert found[2]["text"] == "new" and found[2]["n_removed"] == 1
    assert found[3]["text"] == "" and found[3]["n_removed"] == 0


@pytest.mark.parametrize("hot", [50_000, 2])
def test_substring_dedup(spark, docs, nothing, hot):
    draw = random.Random(5)
    passage = [f"p{draw.randrange(99)}" for _ in range(60)]
    plain = [r[:2] for r in ROWS if r[0] is not None] + [(100 + i, " ".join([f"a{draw.randrange(50)}" for _ in range(draw.randrange(40))] + passage[draw.randrange(9) :] + [f"b{draw.randrange(50)}" for _ in range(20)])) for i in range(30)]
    plain += [(200, "same " * 90), (201, "to and fro " * 20), (202, "z " * 35), (203, "y " * 34)]
    df = wide(spark.createDataFrame(plain, "doc_id bigint, text string")).repartition(3)
    for window in (35, 12):
        found = substring_dedup.deduped(df, window=window, gram=min(8, window), hot=hot)
        assert sorted(tuple(r) for r in found.collect()) == brute.without_repeats(plain, window)
    assert substring_dedup.deduped(docs).count() == len(ROWS)
    assert substring_dedup.deduped(nothing).count() == 0


def test_decontaminate(spark, docs, nothing):
    benchmark = spark.createDataFrame([(1, SOME), (2, None), (3, ""), (4, "x Y"), (5, SOME)], "item_id bigint, text string")
    found = rows(decontaminate.overlaps(docs, benchmark))
    assert found == sorted([(d, i, 24) for d in (1, 2, 12) for i in (1, 5)] + [(11, 4, 2)], key=str)
    words = SOME.split()
    cases = {20: words[:5] + ["?"] + words[6:12], 21: words[:5] + ["?", "?"] + words[7:12], 22: words[12:] + ["tail"], 23: words[:11], 24: ["q"] * 30 + words[3:9] + ["?"] + words[10:15]}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in cases.items()], "doc_id bigint, text string")
    assert {r[0] for r in rows(decontaminate.overlaps(df, benchmark))} == {20, 22, 24}
    left = decontaminate.clean(docs, benchmark)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 4
    assert decontaminate.overlaps(nothing, benchmark).count() == 0
    assert decontaminate.overlaps(docs, benchmark.where("false")).count() == 0


@pytest.mark.parametrize("block", [8 << 20, 64, 2])
def test_token_counts(docs, nothing, block):
    some = docs.where("doc_id IS NULL OR doc_id NOT IN (6, 7)") if block == 2 else docs
    encode = token_counts.encoder(token_counts.VOCABULARY).encode_ordinary
    wanted = sorted(((d, len(encode(x or ""))) for d, x, _ in ROWS if block > 2 or d not in (6, 7)), key=str)
    assert rows(token_counts.counted(some, block_bytes=block)) == wanted
    assert token_counts.counted(nothing).count() == 0


def test_token_scan_of_a_file_without_last_separator(spark, tmp_path):
    import numpy as np

    np.array([9, 9, 7, 7, 1, 2, 3], dtype="<u4").tofile(tmp_path / "a.bin")
    np.array([], dtype="<u4").tofile(tmp_path / "b.bin")
    files = spark.createDataFrame([("a.bin", 7), ("b.bin", 0)], "file string, tokens bigint")
    for block in (4, 8, 12, 100):
        found = token_counts.stitched(token_counts.scanned(files, f"file://{tmp_path}", 7, 4, block))
        assert rows(found) == [("a.bin", 0, 2), ("a.bin", 1, 0), ("a.bin", 2, 3)]


def test_quality(spark, docs, nothing):
    good, bad = "some plain words of a good text that reads well", "buy NOW!!! $$$ click here >>> free"
    train = [(1000 + i, (good if i % 3 else bad) + f" {i}", None) for i in range(400)]
    labels = spark.createDataFrame([(d, int(x.startswith("some")), 0) for d, x, _ in train] + [(None, 1, 0), (1, None, 0), (2, 7, 0)], "doc_id bigint, quality int, toxic int")
    df = wide(spark.createDataFrame(ROWS + train, DOCS))
    model = quality.fit(df, labels)
    found = quality.scored(df, model)
    assert found.columns == [*df.columns, "score_"] and found.count() == len(ROWS) + 400
    held = found.join(labels.select("doc_id", "quality"), "doc_id").where(quality.held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    assert held.count() > 50 and held.where((F.col("score_") >= 0.3) != (F.col("quality") == 1)).count() == 0
    assert found.where("NOT score_ BETWEEN 0 AND 1 OR score_ IS NULL").count() == 0
    left = quality.accepted(df, model)
    assert left.columns == df.columns
    blank = quality.fit(docs, labels.where("false"))
    assert {r[0] for r in quality.scored(docs, blank, "p").select("p").collect()} == {0.5}
    assert quality.scored(nothing, model).count() == 0
    assert quality.fit(nothing, labels).good is None


def test_suffix_tree_lm(docs, nothing):
    import math
    from collections import Counter

    import zlib

    found = suffix_tree_lm.scored(docs).collect()
    assert len(found) == len(ROWS)
    split = [(d, brute.WORD.findall(brute.lowered(x))) for d, x, _ in ROWS]
    learn = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 != 1
    count = Counter(w for d, words in split if learn(d) for w in words)
    ends = sum(learn(d) for d, _ in split)
    total, distinct = sum(count.values()) + ends, len(count) + 1
    base = lambda c: math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    wanted = sorted((str(d), len(w) + 1, sum(count[x] > 0 for x in w) + 1, total, round(sum(base(count[x]) for x in w) + base(ends), 6)) for d, w in split)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == wanted
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    assert suffix_tree_lm.scored(nothing).count() == 0


def letters(draw, n):
    """Texts of few words with copies, near copies and lines that repeat, so that long contexts occur."""
    stems = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 7))) for _ in range(40)]
    texts = [" ".join(draw.choices(stems, range(1, 41), k=draw.randrange(120))) for _ in range(n)]
    texts += [x.upper() for x in texts[: n // 4]] + [x + " end" for x in texts[: n // 6]] + ["the same passage of a few words " * 5 + x for x in texts[: n // 5]]
    return [(i, x) for i, x in enumerate([*texts, None, "", "  ", "b"])] + [(None, texts[0])]


@pytest.mark.parametrize(("bits", "hot", "size"), [(12.0, 1000, 16 << 20), (3.0, 5, 8000)])
def test_suffix_tree_scores_are_those_of_brute_force(spark, monkeypatch, bits, hot, size):
    """In one block or many, with contexts dealt out by followers or not."""
    monkeypatch.setattr(suffix_tree_lm, "BLOCK_BYTES", size)
    monkeypatch.setattr(suffix_tree_lm, "HOT", hot)
    monkeypatch.setattr(suffix_tree_lm, "LEAST_HOT", hot)
    plain = letters(random.Random(5), 120)
    tree, scores = brute.suffix_tree(plain, bits, suffix_tree_lm.PRIOR)
    assert max(map(len, tree)) >= 3
    found = suffix_tree_lm.scored(wide(spark.createDataFrame(plain, "doc_id bigint, text string").repartition(3)), bits).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in found)
    want = sorted((str(d), n, x) for (d, _), (n, x) in zip(plain, scores, strict=True))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 1e-6 * max(1, abs(b[2])) for a, b in zip(got, want, strict=True))


def test_suffix_tree_is_a_distribution():
    """Behind every context, the probabilities of all tokens and of the unknown one add up to 1."""
    tree, _ = brute.suffix_tree(letters(random.Random(7), 60), 1.0, suffix_tree_lm.PRIOR)
    tokens = [*tree[()].counts, "an unknown word"]
    assert len(tree) > 50
    assert all(abs(sum(brute.behind(tree, context, w) for w in tokens) - 1) < 1e-9 for context in tree)


def test_suffix_tree_asks_for_the_same_evidence_of_a_larger_corpus():
    """Followers of a context, beside a corpus as it is or a million times larger, are judged alike but for their rarity."""
    size, twice = np.array([30, 4, 2, 2]), np.array([30, 4, 2, 0])
    for p in (1e-4, 1e-10):
        gain = twice * (np.log2(np.maximum(twice, 1)) - np.log2(p))
        assert (suffix_tree_lm.gains(size, twice, gain) >= suffix_tree_lm.BITS).tolist() == [True, True, True, False]


def test_suffix_tree_asks_only_for_contexts_that_may_stay():
    """What occurs too rarely beside its shorter context is not asked for; whatever passes the test is."""
    most, room = np.array([1, 2, 2, 3, 3, 100]), np.array([1e9, 120, 140, 40, 60, 101.0])
    assert suffix_tree_lm.worth(most, room, 12.0).tolist() == [False, False, True, False, True, True]  # of 100 in 101, there may be fewer
    draw = random.Random(3)
    for _ in range(3000):
        n = np.array([draw.randrange(2, 6) for _ in range(draw.randrange(1, 4))])
        size = int(n.sum()) + draw.randrange(2)
        behind = n + [draw.choice((0, 1, 9)) for _ in n]  # in the shorter context
        room = max(int(behind.sum()), size) + draw.choice((0, 5, 50, 500)) + 0.5
        steps = np.rint(-suffix_tree_lm.STEPS * np.log2(behind / room)) / suffix_tree_lm.STEPS
        gain = suffix_tree_lm.gains(np.array([size]), np.array([n.sum()]), np.array([(n * (np.log2(n) + steps)).sum()]))[0]
        assert suffix_tree_lm.worth(np.array([size]), np.array([room]), max(gain, 0.1))[0] or gain <= 0


def test_suffix_tree_numbers_come_back_from_their_packed_forms():
    lm = suffix_tree_lm
    for x in ([], [0], [0, 0, 7, 300, 0, 2**33], [255] * 9):
        x = np.array(x, dtype=np.int64)
        assert lm.unpacked(lm.packed(x)).tolist() == lm.unsparse(lm.sparse(x)).tolist() == x.tolist()
        assert lm.unfolded(lm.folded(x - 5)).tolist() == (x - 5).tolist()
    assert lm.unpacked(lm.packed(np.array([-0.5, 1e300])), np.float64).tolist() == [-0.5, 1e300]
    sizes, x = np.array([2, 0, 3, 1]), np.array([5, 9, 1, 2, 7, 3], dtype=np.uint64)
    assert lm.unstepped(lm.stepped(x, lm.starts(sizes)), sizes).tolist() == x.tolist()


def test_suffix_tree_sums_of_a_block_without_finished_places_are_fractions():
    """Where the tree goes on from every place of a block, the sums are packed as those of other blocks."""
    own = object.__new__(suffix_tree_lm.Block)
    own.row, own.p, own.counts = np.array([0, 0, 1]), np.array([0.5, 0.5, 0.1]), np.array([2, 1])
    for left in (np.empty(0, np.int64), np.arange(3)):
        assert len(suffix_tree_lm.unpacked(suffix_tree_lm.packed(own.sums(left)), np.float64)) == 2


PAGES = [(1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, None, None), (4, "http://c", ""), (5, "u\r\nX: y", "é\x00\r\n\r\nWARC/1.1"), (6, "http://d", "<p>" + LONG), (7, "http://e", "<p>same</p>"), (7, "http://e", "<p>same</p>"), (None, "http://f", "<p>same</p>"), (None, "http://g", "alone")]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    found = warc.round_trip(pages).collect()
    assert len(found) == len(PAGES)
    kinds = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in found)
    assert kinds == sorted([("1", "revisit", "7"), ("2", "revisit", "7"), ("3", "revisit", "4"), ("4", "response", "None"), ("5", "response", "None"), ("6", "response", "None"), ("7", "response", "None"), ("7", "response", "None"), ("None", "revisit", "7"), ("None", "response", "None")])
    sent = {(p, (h or "").encode()) for p, _, h in PAGES}
    assert all((r["page_id"], bytes(r["payload"])) in sent for r in found if r["record_type"] == "response")
    assert all(r["payload_digest"] == warc.payload_digest((h or "").encode()) and r["payload_bytes"] == len((h or "").encode()) for r in found for p, _, h in PAGES if p is not None and p == r["page_id"])
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_inflates_in_small_steps(monkeypatch):
    import io
    import zlib

    monkeypatch.setattr(warc, "BLOCK", 7)
    records = [warc.record("response", i, "http://a", warc.HTTP + bytes([i]) * i, "D", i) for i in range(20)]
    for stream in (zlib.compress(b"".join(records), wbits=31), b"".join(zlib.compress(r, wbits=31) for r in records)):
        assert [h + b"\r\n\r\n" + b + b"\r\n\r\n" for h, b in warc.Inflated(io.BytesIO(stream)).records()] == records


def test_quality_starts_no_second_kind_of_workers(spark, monkeypatch):
    """Rows from the driver go through Python workers that executors hold beside those of mapInArrow."""
    df = spark.createDataFrame([(i, f"{SOME if i % 2 else 'junk ' * 20} {i}", "a") for i in range(200)], DOCS)
    labels = df.select("doc_id", F.pmod("doc_id", F.lit(2)).alias("quality"), F.lit(0).alias("toxic"))
    df, labels = storage.written(df, "test-docs"), storage.written(labels, "test-labels")

    def refused(*_, **__):
        raise AssertionError("rows of the driver")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    model = quality.fit(df, labels)
    assert model.good and model.bad
    assert quality.accepted(df, model).where("doc_id % 2 = 1").count() == 100


def test_a_task_leaves_no_memory_in_its_worker():
    """Many small arrays below one that stays: freed, but only a trim gives them back."""
    stays = []

    def run(batches):
        for batch in batches:
            held = [np.ones(8000) for _ in range(3000)]
            stays.append(np.ones(8000))
            yield batch
            del held

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    before = resident()
    assert list(storage.lean(run)(iter([0]))) == [0]
    assert resident() - before < 60
