from formulary import Engine
from formulary.streaming.lookback import stream_table, with_lookback


def run(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def test_stateless(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.0), (2, 5.0)], "id int, v double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = stream_table(spark, str(tmp_path / "in"), rows.schema)
    engine = Engine().with_params(limit=3)
    out = run(engine.filter(engine.with_expressions(stream, {"twice": "v * 2", "hot": "twice > $limit"}), "hot"), "stateless")
    assert [tuple(r) for r in out.collect()] == [(2, 5.0, 10.0, True)]


def test_lookback_over_batches(spark, tmp_path):
    schema = "k string, i int, v double"
    for n, part in enumerate(([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 9.0)], [("a", 2, 4.0), ("b", 1, 8.0)], [("b", 2, 7.0), ("a", 3, 3.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del n
    whole = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    texts = {"up": "rising(v, 3)", "back": "v[2] + v", "down": "falling(v, 2)"}
    got = run(with_lookback(Engine(), stream, ["k"], "i", texts), "lookback")
    want = Engine().over("k", "i").with_expressions(whole, texts)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_lookback_keeps_whole_numbers(spark, tmp_path):
    """A NULL in a column does not turn its large numbers into rounded ones."""
    schema, large = "k string, i bigint, v bigint", 9007199254740993
    for part in ([("a", 9, large), ("a", 10, None)], [("a", 11, large + 2)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(with_lookback(Engine(), stream, ["k"], "i", {"back": "v[2]"}), "whole_numbers").orderBy("i").collect()
    assert [(r["i"], r["v"]) for r in got] == [(9, large), (10, None), (11, large + 2)]
    assert [r["back"] for r in got] == [None, None, float(large)]
