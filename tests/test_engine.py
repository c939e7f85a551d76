import math
import random

import pytest
from pyspark.sql import functions as F

from formulary import BOOL, NUMBER, Engine, ExpressionSet, standard
from formulary.errors import CircularDependency, DivisionByZero, ExpressionSyntaxError, TypeMismatch, UnknownFunction, UnknownIdentifier, WrongArity, runtime_error
from formulary.operators import series
from formulary.plans import parser
from formulary.plans import tree as t
from formulary.sources.tables import contexts, with_struct

NAN, INF = float("nan"), float("inf")
ROW = {"a": 1.5, "b": 2.5, "z": 0.0, "neg": -5.5, "nan": NAN, "inf": INF, "yes": True, "no": False, "pose": {"x": 3.0, "y": 4.0}, "outer": {"inner": {"value": 7.0, "flag": True}}}


@pytest.fixture(scope="module")
def one(spark):
    return contexts(spark, [ROW])


def values(df, engine, texts):
    return list(df.select(*[engine.column(df, x).alias(f"c{i}") for i, x in enumerate(texts)]).first())


def close(x, y):
    if isinstance(y, float):
        return isinstance(x, float) and (math.isnan(x) and math.isnan(y) or x == y or abs(x - y) < 1e-10 * max(1, abs(y)))
    return x == y


GOLDEN = {
    "a + b * 2": 6.5, "neg % 2": -1.5, "-2 ^ 2": -4.0, "2 ^ 3 ^ 2": 512.0, "a > b": False, "nan > 1": False, "nan < 1": False, "nan >= nan": False, "nan <= nan": False, "nan == nan": False, "nan != nan": True,
    "nan != 1": True, "1 == nan": False, "inf > 1": True, "yes == no": False, "yes != no": True, "not no": True, "a in [1, 2]": True, "a not in [1, 2]": False, "nan in [0, 1]": False, "yes ? a : b": 1.5,
    "if(2, a, b)": 1.5, "if(z, a, b)": 2.5, "if(nan, a, b)": 1.5, "if(no, 1 / z, 3)": 3.0, "no and 1 / z > 1": False, "yes or 1 / z > 1": True, "null": NAN, "min(nan, 1)": NAN, "min(1, nan)": 1.0, "max(nan, 1)": NAN, "max(1, nan, 3)": 3.0,
    "min(3, 1, 2)": 1.0, "clamp(5, 10, 0)": 5.0, "clamp(nan, 0, 1)": NAN, "clamp(-1, 0, 1)": 0.0, "sign(neg)": -1.0, "sign(nan)": 0.0, "sign(z)": 0.0, "lerp(0, 10, 0.25)": 2.5, "smoothstep(0.5, 0, 1)": 0.5, "smoothstep(1, 1, 1)": 1.0,
    "smoothstep(0, 1, 1)": 0.0, "sigmoid(0, 0, 3)": 0.5, "floor(neg)": -6.0, "ceil(neg)": -5.0, "round(2.5)": 3.0, "round(-2.5)": -3.0, "trunc(neg)": -5.0, "floor(nan)": NAN, "floor(inf)": INF, "floor(1e300)": 1e300, "sqrt(-1)": NAN, "cbrt(27)": 3.0,
    "pow(1, nan)": 1.0, "pow(nan, 0)": 1.0, "2 ^ 0.5": math.sqrt(2), "exp(1)": math.e, "exp2(3)": 8.0, "log(0)": -INF, "log(-1)": NAN, "log(e())": 1.0, "log10(1000)": 3.0, "log2(8)": 3.0, "atan2(1, 1)": math.pi / 4, "tanh(z)": 0.0, "pi()": math.pi, "inf()": INF,
    "pose.x * pose.y": 12.0, "outer.inner.value": 7.0, "outer.inner.flag": True, "a |> abs |> clamp(0, 1)": 1.0, "$p + $g.h": 12.0, "a GE 1 AND b LT 3": True, "abs(neg)": 5.5, "log(nan)": NAN, "inf() - inf() > 1": False, "1e999 - 1e999 >= 0": False, "1 < inf()": True,
}


def test_golden(one):
    engine = Engine().with_params(p=10, **{"g.h": 2})
    texts = list(GOLDEN)
    for text, got in zip(texts, values(one, engine, texts), strict=True):
        assert close(got, GOLDEN[text]), (text, got, GOLDEN[text])


@pytest.mark.parametrize(("text", "error"), [
    ("a + yes", TypeMismatch), ("yes > no", TypeMismatch), ("a and b", TypeMismatch), ("not a", TypeMismatch), ("-yes", TypeMismatch), ("a == yes", TypeMismatch), ("a ? 1 : 2", TypeMismatch), ("yes ? a : no", TypeMismatch),
    ('"text"', TypeMismatch), ("if(pose, 1, 2)", TypeMismatch), ("sqrt(yes)", TypeMismatch), ("a.x", TypeMismatch), ("pose.x.y", TypeMismatch), ("missing", UnknownIdentifier), ("$missing", UnknownIdentifier), ("pose.w", UnknownIdentifier),
    ("nope(1)", UnknownFunction), ("nope(1).x", UnknownFunction), ("sqrt()", WrongArity), ("clamp(1, 2)", WrongArity), ("rising(a)", WrongArity), ("a[1]", ExpressionSyntaxError), ("rising(a, 1)", ExpressionSyntaxError), ("clamp(x=1, 2, 3)", ExpressionSyntaxError),
])
def test_errors(one, text, error):
    with pytest.raises(error):
        Engine().column(one, text)


def test_division_by_zero(one):
    for text, message in (("a / z", "Division by zero"), ("a % z", "Modulo by zero")):
        with pytest.raises(Exception) as caught:
            values(one, Engine(), [text])
        found = runtime_error(caught.value)
        assert isinstance(found, DivisionByZero) and found.message == message
        assert values(one, Engine(on_zero="null"), [text]) == [None]


def test_null_propagates(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    texts = ["x + y", "x > y", "min(y, x)", "max(x, y)", "clamp(y, x, 2)", "floor(x)", "log(x)", "sign(x)", "pow(1, x)", "smoothstep(y, x, 2)", "x > 0 ? 1 : 2", "round(x)", "trunc(x)"]
    assert values(df, Engine(), texts) == [None] * len(texts)
    assert values(df, Engine(), ["x > 0 and y > 2", "y > 0 or x > 0"]) == [False, True]


def test_registry(one):
    registry = standard()
    registry.define("sq(x) => x * x")
    registry.define("hyp(x, y) => sqrt(sq(x) + sq(y))")
    registry.define("length(p) => hyp(p.x, p.y)")
    registry.define("twice(q) => 2 * length(q)")
    registry.define("big(x) => x > 1")
    registry.add_binary("sub", lambda x, y: x - y)
    registry.set_param_names("sub", ["left", "right"])
    registry.producer("band", lambda x, w: {"up": x + w, "wide": w > 1}, {"up": NUMBER, "wide": BOOL}, 2, ("x", "w"))
    registry.producer("origin", lambda: {"x": F.lit(1.0)}, ("x",), 0)
    registry.add("band", lambda x, w: x * w, 2)
    registry.struct_function("norm", lambda x, y: F.sqrt(x * x + y * y), ["x", "y"], 1)
    registry.add_typed("pick", lambda c, x: F.when(c, x), [BOOL, NUMBER], NUMBER)
    registry.macro("swap", lambda call, compiler: t.Binary("-", call.args[1], call.args[0]))
    registry.add_pandas("plus_one", lambda s: s + 1, 1)
    registry.overlay("sub", lambda call, compiler: t.Number(9.0) if any(isinstance(x, t.Text) for x in call.args) else None)
    texts = {"hyp(3, 4)": 5.0, "length(pose)": 5.0, "twice(pose)": 10.0, "big(a)": True, "sub(right=1, left=3)": 2.0, "sub(1, right=3)": -2.0, 'sub(1, "x")': 9.0, "band(w=2, x=1).up": 3.0, "(band(1, 2)).wide": True,
             "band(2, 4)": 8.0, "origin.x": 1.0, "norm(pose)": 5.0, "pick(yes, a)": 1.5, "swap(1, 3)": 2.0, "plus_one(a)": 2.5, "origin().x + 1": 2.0}
    assert values(one, Engine(registry), list(texts)) == list(texts.values())
    assert registry.lookup("hyp") == (2, 2) and registry.lookup("none") is None and registry.lookup("min") == (1, 8)
    assert one.select(registry.call("sub", F.col("b"), 1.0)).first()[0] == 1.5
    for text, error in (("sub(1, left=2)", ExpressionSyntaxError), ("sub(right=2)", ExpressionSyntaxError), ("sub(wrong=2)", ExpressionSyntaxError), ("hyp(1)", WrongArity), ("length(a)", TypeMismatch), ("norm(1)", ExpressionSyntaxError), ("pick(1, 2)", TypeMismatch), ("band(1, 2).none", UnknownIdentifier)):
        with pytest.raises(error):
            Engine(registry).column(one, text)
    registry.define("loop(x) => loop(x)")
    with pytest.raises(ExpressionSyntaxError):
        Engine(registry).column(one, "loop(1)")
    before = registry.version
    registry.add_unary("sqrt", lambda x: x)
    assert registry.version > before and values(one, Engine(registry), ["sqrt(9)"]) == [9.0]
    for text in ("f => 1", "f(x, x) => x", "f(x) =>", "f(1) => 2"):
        with pytest.raises(ExpressionSyntaxError):
            registry.define(text)


def test_struct_beats_flat_column_and_producer(spark):
    df = contexts(spark, [{"p": {"x": 1.0}, "p.y": 2.0, "q.x": 3.0}])
    registry = standard()
    registry.producer("q", lambda: {"x": F.lit(8.0), "w": F.lit(9.0)}, ("x", "w"), 0)
    assert values(df, Engine(registry), ["p.x", "p.y", "q.x", "q.w"]) == [1.0, 2.0, 3.0, 9.0]
    assert values(with_struct(contexts(spark, [{"u": 1, "v": 2}]), "s", {"a": "u", "b": "v"}), Engine(), ["s.a + s.b"]) == [3.0]


def test_baskets(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, []), (3, [NAN, 5.0])], "id int, role array<double>")
    engine = Engine(standard(with_baskets=True)).with_params(pair=[1, 2, 3], role=F.col("role"), one=[7], none=[])
    texts = {"avg($pair)": 2.0, "count($pair)": 3.0, "min($pair)": 1.0, "max($pair * 2)": 6.0, "any($pair > 2)": True, "all($pair > 0)": True, "avg($pair - avg($role))": 0.0, "avg(1, 2, 6)": 3.0, "avg($one)": 7.0, "count($none)": 0.0, "avg($none)": 0.0, "min($none)": 0.0, "avg(4)": 4.0, "min(2, 1)": 1.0}
    got = values(df.where("id = 1"), engine, list(texts))
    assert got == list(texts.values()), dict(zip(texts, got, strict=True))
    assert values(df.where("id = 2"), engine, ["avg($role)", "max($role)", "any($role > 0)", "all($role > 0)", "count($role)"]) == [0.0, 0.0, False, False, 0.0]
    assert close(values(df.where("id = 3"), engine, ["min($role)"])[0], NAN)
    for text in ("avg($pair + $role)", "count(1)", "any(1, 2)"):
        with pytest.raises(UnknownIdentifier):
            engine.column(df, text)


BARS = [10.0, 11.0, 12.0, 13.0, 14.0]


def test_series(spark):
    shapes = {"up": [9, 10, 11, 12, 13], "down": [13, 12, 11, 10, 9], "mixed": [13, 12, 11, 12, 13]}
    rows = [("s", i, c, b) for i, (c, b) in enumerate(zip(BARS, [2, 3, 4, 5, 6], strict=True))] + [(k, i, float(v), 0) for k, vs in shapes.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame([(a, b, float(c), float(d)) for a, b, c, d in rows], "id string, i int, close double, base double")
    registry = standard()
    registry.define("spread(x, y) => x - y[1]")
    engine = Engine(registry).over("id", "i")
    texts = {"off": "(close + base)[2]", "cmp": "(close > base)[1]", "nest": "close[1][2]", "up": "rising(close, 3)", "down": "falling(close, 3)", "fn": "spread(close, base)", "fn1": "spread(close, base)[1]", "n": "close[$n]", "avg": "sma(close, 2)[1]"}
    found = engine.with_params(n=2).with_expressions(df, texts).where("i = 4").toPandas().set_index("id")
    s = found.loc["s"]
    assert (s["off"], s["cmp"], s["nest"], s["fn"], s["fn1"], s["n"], s["avg"]) == (16.0, True, 11.0, 9.0, 9.0, 12.0, 12.5)
    assert found["up"].to_dict() == {"s": True, "up": True, "down": False, "mixed": True} and found["down"].to_dict() == {"s": False, "up": False, "down": True, "mixed": False}
    first = engine.with_expressions(df, {"v": "close[1]", "w": "rising(close, 2)"}).where("i = 0 and id = 's'").first()
    assert first["v"] is None and first["w"] is None
    assert df.select("id", "i", engine.at_offset(df, "close + base", 2).alias("v")).where("id = 's' and i = 4").first()["v"] == 16.0
    for text in ("close[-1]", "close[0.5]"):
        with pytest.raises(ExpressionSyntaxError):
            engine.column(df, text)
    plan = df.select(engine.column(df, "rising(close, 4) and close[2] > base[1]"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1


def test_recurrence_of_an_oscillator(spark):
    """A loop-carried state over 1500 steps."""
    df = spark.range(1500).select(F.lit(0).alias("run"), F.col("id"))

    def step(s, _):
        drive = 1.25 * math.cos(1.1 * s["t"])
        a = (drive - 9 * s["x"] - 0.8 * s["v"]) / 2
        v = s["v"] + a * 0.01
        return {"x": s["x"] + v * 0.01, "v": v, "t": s["t"] + 0.01}

    out = series.scan(df, ["run"], ["id"], lambda: {"x": 0.75, "v": -0.2, "t": 0.0}, step, {"x": "double", "v": "double"})
    state = {"x": 0.75, "v": -0.2, "t": 0.0}
    for _ in range(1500):
        state = step(state, None)
    last = out.orderBy(F.desc("id")).first()
    assert (last["x"], last["v"]) == (state["x"], state["v"])


def test_named_expressions(one):
    named = ExpressionSet()
    named.add_all({"signal": "position > 1 and ok", "position": "risk * 2", "risk": "a / b", "ok": "yes", "s": "pose", "t": "s.x"})
    assert named.order() == ["risk", "ok", "s", "position", "t", "signal"]
    row = named.applied(Engine(), one).first()
    assert (row["risk"], row["position"], row["signal"], row["t"]) == (0.6, 1.2, True, 3.0)
    with pytest.raises(ExpressionSyntaxError):
        named.add_all({"fine": "1", "broken": "1 +"})
    assert "fine" not in named.nodes
    for loop in ({"p": "q", "q": "p + 1"}, {"p": "p + 1"}):
        broken = ExpressionSet()
        broken.add_all(loop)
        with pytest.raises(CircularDependency):
            broken.order()
        with pytest.raises(CircularDependency):
            broken.levels()
    found, order = named.analyze(Engine(), one)
    assert found["signal"].is_predicate and found["signal"].uses_expressions and order[-1] == "signal"


def test_trading_bars(spark):
    rows = [(100.0, 99.0, 98.0, 55, 1200000), (98.0, 99.0, 98.2, 58, 1400000), (97.0, 98.5, 98.1, 45, 800000)]
    df = contexts(spark, [dict(zip(("close", "fast", "slow", "rsi", "volume"), r, strict=True)) for r in rows])
    out = Engine().with_params(min_volume=1000000).with_expressions(df, {"entry": "trend and pullback and volume > $min_volume", "trend": "fast > slow", "pullback": "close < fast and rsi < 50"})
    assert [r["entry"] for r in out.collect()] == [False, False, False]
    assert [r["trend"] for r in out.collect()] == [True, True, True]


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = Engine().filter(df, "l_quantity in [10, 20] and l_extendedprice > 1000").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThan(l_extendedprice" in pushed and "GreaterThanOrEqual(l_quantity" in pushed and "l_tax" not in plan


def test_aggregates_over_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "k int, v double")
    out = Engine().aggregate(df, ["k"], a="avg(v * 2)", lo="min(v)", hi="max(v)", some="any(v > 2)", every="all(v > 2)", n="count(v)").orderBy("k").collect()
    assert [tuple(r) for r in out] == [(1, 4.0, 1.0, 3.0, True, False, 2.0), (2, 10.0, 5.0, 5.0, True, True, 1.0)]


# Random expressions against a plain evaluator

def plain(node, row):
    match node:
        case t.Number(x) | t.Bool(x):
            return x
        case t.Identifier(name):
            return row[name]
        case t.Unary("not", x):
            return not plain(x, row)
        case t.Unary(_, x):
            return -plain(x, row)
        case t.Ternary(c, x, y):
            return plain(x, row) if plain(c, row) else plain(y, row)
        case t.Call("min", args, _):
            out = plain(args[0], row)
            for x in args[1:]:
                y = plain(x, row)
                out = y if y < out else out
            return out
        case t.Call("abs", (x,), _):
            return abs(plain(x, row))
        case t.Binary("and", x, y):
            return plain(x, row) and plain(y, row)
        case t.Binary("or", x, y):
            return plain(x, row) or plain(y, row)
        case t.Binary(op, x, y):
            x, y = plain(x, row), plain(y, row)
            return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y, "==": lambda: x == y, "!=": lambda: x != y}[op]()
    raise TypeError(node)


def grow(draw, kind, depth):
    if depth == 0:
        return draw.choice([t.Identifier(n) for n in ("p", "q", "r")] + [t.Number(draw.choice((0.0, 1.0, -2.5, NAN)))]) if kind == "n" else draw.choice((t.Identifier("f"), t.Bool(True), t.Bool(False)))
    sub = lambda k: grow(draw, k, depth - draw.choice((1, 1, 2)) if depth > 1 else 0)
    if kind == "n":
        return draw.choice([lambda: t.Binary(draw.choice("+-*"), sub("n"), sub("n")), lambda: t.Unary("-", sub("n")), lambda: t.Ternary(sub("b"), sub("n"), sub("n")), lambda: t.Call("min", (sub("n"), sub("n")), (None, None)), lambda: t.Call("abs", (sub("n"),), (None,))])()
    return draw.choice([lambda: t.Binary(draw.choice(("<", "<=", ">", ">=", "==", "!=")), sub("n"), sub("n")), lambda: t.Binary(draw.choice(("and", "or")), sub("b"), sub("b")), lambda: t.Unary("not", sub("b")), lambda: t.Binary(draw.choice(("==", "!=")), sub("b"), sub("b"))])()


def test_random_expressions(spark):
    draw = random.Random(42)
    rows = [{"p": p, "q": q, "r": draw.choice((0.5, -3.0)), "f": f} for p in (NAN, 0.0, 2.0, INF) for q in (NAN, -1.0, 2.0) for f in (True, False)]
    df = contexts(spark, rows).coalesce(1)
    nodes = [grow(draw, draw.choice("nb"), draw.randrange(1, 5)) for _ in range(120)]
    compiled = [Engine().compile(df, parser.parse(t.render(n))).column.alias(f"c{i}") for i, n in enumerate(nodes)]
    got = df.select("p", "q", "r", "f", *compiled).collect()
    for row in got:
        for i, node in enumerate(nodes):
            want = plain(node, row.asDict())
            want = float(want) if not isinstance(want, bool) else want
            assert close(row[f"c{i}"], want), (t.render(node), row, row[f"c{i}"], want)


def test_lookback_by_rows_and_strict(spark):
    df = spark.createDataFrame([(i, float(10 + i), i % 3, None if i == 4 else i) for i in range(6)], "i int, v double, n int, m int")
    engine = Engine(most_back=3).over([], "i")
    read = lambda e, text: [r["x"] for r in e.select(df, ["i"], x=text).orderBy("i").collect()]
    assert read(engine, "v[n]") == [10.0, 10.0, 10.0, 13.0, 13.0, 13.0]
    assert read(engine, "(v + i)[n + 0]") == [10.0, 10.0, 10.0, 16.0, 16.0, 16.0]
    assert read(engine, "v[m * 0 + 1]") == [None, 10.0, 11.0, 12.0, None, 14.0]
    assert read(engine, "rising(v, n + 2)") == [None, None, None, True, True, True]
    for text in ("v[i]", "v[n - 1]", "v[n / 2]", "rising(v, n)", "falling(v, i + 2)"):
        with pytest.raises(Exception, match="lookback|looks at"):
            read(engine, text)
    strict = Engine(strict=True).over([], "i")
    assert read(strict, "v[0] + v") == [20.0 + 2 * i for i in range(6)]
    for text in ("v[1]", "v[i + 1]", "rising(v, 2)"):
        with pytest.raises(Exception, match="beyond the first row"):
            read(strict, text)


def test_recurrences_keep_nulls_and_large_numbers(spark):
    """Columns go through unchanged, over many batches; a NULL leaves an average as it was."""
    large = 9007199254740993
    rows = [(k, i, None if (i + k) % 3 == 0 else float(i * k % 7), large if i % 2 else None) for k in range(5) for i in range(40)]
    rows += [(9, 0, 1.0, 1), (9, 1, float("nan"), 2), (9, 2, 3.0, 3), (10, 0, 2.0, 4), (11, 0, None, 5)]
    df = spark.createDataFrame(rows, "k int, i int, v double, b bigint")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = series.ema(df, ["k"], ["i"], "v", 4).collect()
        counted = series.scan(df, ["k"], ["i"], lambda: {"seen": 0}, lambda s, r: {"seen": s["seen"] + (r["b"] is not None)}, {"seen": "bigint"}).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r["k"], r["i"], str(r["b"])) for r in found) == sorted((k, i, str(b)) for k, i, _, b in rows)
    want, last = {}, {}
    for k, i, v, _ in rows:
        last[k] = last.get(k) if v is None else v if last.get(k) is None else last[k] + 0.4 * (v - last[k])
        want[k, i] = last[k]
    for r in found:
        w = want[r["k"], r["i"]]
        assert (r["ema"] is None) == (w is None) and (w is None or str(round(r["ema"], 9)) == str(round(w, 9)) or abs(r["ema"] - w) < 1e-9)
    assert {(r["k"], r["i"]): r["seen"] for r in counted}[3, 39] == 20
