"""Registered queries of the expression engine, with their oracle SQL.

Each runs over a whole table. Results of transcendental functions and of sums over
many rows are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formulary.operators import grouped, series
from formulary.plans import tree as t
from formulary.plans.types import BOOL, NUMBER
from formulary.session import Engine, standard
from formulary.sources.tables import table

KEYS = ("l_orderkey", "l_linenumber")
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def query(oracle: str | None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        _queries[function.__name__] = function
        if oracle:
            _oracle[function.__name__] = oracle
        return function

    return add


def lineitem(name: str, expressions: dict[str, str], oracle: dict[str, str], engine: Callable[[], Engine] = Engine, digits: int | None = None) -> None:
    """A query of expressions over lineitem, beside the same in SQL."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = table(spark, folder, "lineitem")
        made, e = engine(), {}
        for column, text in expressions.items():
            value = made.compile(df, text)
            e[column] = F.round(value.column, digits) if digits is not None and value.type is NUMBER else value.column
        return df.select(*KEYS, *[c.alias(k) for k, c in e.items()])

    sql = ", ".join(f"round({text}, {digits}) AS {k}" if digits is not None else f"{text} AS {k}" for k, text in oracle.items())
    _queries[name] = run
    _oracle[name] = f"SELECT {', '.join(KEYS)}, {sql} FROM lineitem"


FLAGSHIP = {
    "hot": "net > $min_net and l_quantity in [10, 40]",
    "gross": "net * (1 + l_tax)",
    "net": "l_extendedprice * (1 - l_discount)",
}


@query("""
WITH a AS (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)
SELECT l_orderkey, l_linenumber, net, net * (1 + l_tax) AS gross FROM a WHERE net > 1000 AND l_quantity BETWEEN 10 AND 40
""")
def flagship(spark: SparkSession, folder: str) -> DataFrame:
    df = Engine().with_params(min_net=1000).with_expressions(table(spark, folder, "lineitem"), FLAGSHIP)
    return df.where("hot").select(*KEYS, "net", "gross")


# Operators

lineitem("arith", {"v": "l_extendedprice * (1 - l_discount) + l_tax - l_quantity / 4"}, {"v": "l_extendedprice * (1 - l_discount) + l_tax - l_quantity / 4"})
lineitem("unary", {"v": "-l_tax + +l_quantity"}, {"v": "-l_tax + l_quantity"})
lineitem("modulo", {"v": "l_extendedprice % 7", "w": "-l_extendedprice % 7"}, {"v": "l_extendedprice % 7", "w": "(-l_extendedprice) % 7"})
lineitem("power_right_assoc", {"v": "2 ^ 3 ^ 2 + l_discount", "w": "l_tax ** 2"}, {"v": "512 + l_discount", "w": "l_tax ^ 2"}, digits=6)
lineitem("unary_power", {"v": "-l_quantity ^ 2"}, {"v": "-(l_quantity * l_quantity)"})
lineitem("compare", {"a": "l_quantity < 10", "b": "l_quantity <= 10", "c": "l_quantity > 10", "d": "l_quantity >= 10"}, {"a": "l_quantity < 10", "b": "l_quantity <= 10", "c": "l_quantity > 10", "d": "l_quantity >= 10"})
lineitem("compare_aliases", {"v": "l_quantity ge 10 AND l_tax lt 0.05", "w": "l_quantity eq 10 or l_quantity NE 20"}, {"v": "l_quantity >= 10 AND l_tax < 0.05", "w": "l_quantity = 10 OR l_quantity <> 20"})
# Products of whole numbers that overflow: the difference of two infinities is NaN, of which only != is true.
lineitem("compare_overflow", {"a": "l_partkey * 1e308 * 10 - l_partkey * 1e308 * 10 > 1", "b": "l_partkey * 1e308 * 10 - l_partkey * 1e308 * 10 == l_partkey * 1e308 * 10 - l_partkey * 1e308 * 10", "c": "l_partkey * 1e308 * 10 - l_partkey * 1e308 * 10 != 0", "d": "(1e308 * 10) - (1e308 * 10) >= 1", "e": "l_partkey * 2 > 10"}, {"a": "false", "b": "l_partkey = 0", "c": "l_partkey <> 0", "d": "false", "e": "l_partkey * 2 > 10"})
lineitem("equality_bool", {"v": "(l_tax > 0.04) == (l_discount > 0.04)", "w": "(l_tax > 0.04) != true"}, {"v": "(l_tax > 0.04) = (l_discount > 0.04)", "w": "(l_tax > 0.04) <> true"})
lineitem("interval_in", {"v": "l_quantity in [10, 20]"}, {"v": "l_quantity BETWEEN 10 AND 20"})
lineitem("interval_not_in", {"v": "l_quantity not in [max=20, min=10]"}, {"v": "l_quantity NOT BETWEEN 10 AND 20"})
lineitem("logic", {"v": "not (l_quantity > 30) and !(l_tax > 0.04) || l_discount == 0"}, {"v": "(NOT l_quantity > 30 AND NOT l_tax > 0.04) OR l_discount = 0"})
lineitem("logic_short_circuit", {"v": "l_discount != 0 and l_tax / l_discount > 1", "w": "l_discount == 0 or l_tax / l_discount > 1"}, {"v": "CASE WHEN l_discount <> 0 THEN l_tax / l_discount > 1 ELSE false END", "w": "CASE WHEN l_discount = 0 THEN true ELSE l_tax / l_discount > 1 END"})
lineitem("ternary", {"v": "l_quantity > 25 ? l_tax : l_discount > 0.05 ? 1 : 2"}, {"v": "CASE WHEN l_quantity > 25 THEN l_tax WHEN l_discount > 0.05 THEN 1 ELSE 2 END"})
lineitem("if_fn", {"v": "if(l_quantity > 25, 1, 0)", "w": "if(l_discount, 1 / l_discount, -1)"}, {"v": "CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "w": "CASE WHEN l_discount <> 0 THEN 1 / l_discount ELSE -1 END"})
lineitem("pipe", {"v": "(l_tax - l_discount) |> abs |> clamp(0, 0.05)"}, {"v": "least(greatest(abs(l_tax - l_discount), 0), 0.05)"})
lineitem("params", {"v": "l_extendedprice > $min_price", "w": "l_tax * $rate.high"}, {"v": "l_extendedprice > 20000", "w": "l_tax * 1.5::DOUBLE"}, lambda: Engine().with_params(**{"min_price": 20000, "rate.high": 1.5}))
lineitem("null_divisor", {"v": "l_tax / l_discount", "w": "l_tax % l_discount"}, {"v": "l_tax / nullif(l_discount, 0)", "w": "l_tax % nullif(l_discount, 0)"}, lambda: Engine(on_zero="null"), digits=6)
lineitem("nan_literal", {"a": "null == null", "b": "nan() > 1", "c": "null != 1", "d": "min(l_tax, nan())", "e": "l_tax >= null"}, {"a": "false", "b": "false", "c": "true", "d": "l_tax", "e": "false"})

# Functions

lineitem("fn_minmax", {"a": "min(l_tax, l_discount, 0.03)", "b": "max(l_tax, l_discount, 0.03)", "c": "min(l_tax)"}, {"a": "least(l_tax, l_discount, 0.03::DOUBLE)", "b": "greatest(l_tax, l_discount, 0.03::DOUBLE)", "c": "l_tax"})
lineitem("fn_clamp", {"a": "clamp(l_quantity, 10, 20)", "b": "clamp(l_quantity, 20, 10)"}, {"a": "least(greatest(l_quantity, 10), 20)::DOUBLE", "b": "least(greatest(l_quantity, 10), 20)::DOUBLE"})
lineitem("fn_sign", {"v": "sign(l_tax - l_discount)"}, {"v": "CAST(sign(l_tax - l_discount) AS DOUBLE)"})
lineitem("fn_lerp", {"v": "lerp(l_tax, l_discount, 0.25)"}, {"v": "l_tax + (l_discount - l_tax) * 0.25::DOUBLE"}, digits=9)
lineitem("fn_smoothstep", {"v": "smoothstep(l_quantity, 10, 40)", "w": "smoothstep(l_quantity, 20, 20)"}, {"v": "pow(least(greatest((l_quantity - 10) / 30, 0), 1), 2) * (3 - 2 * least(greatest((l_quantity - 10) / 30, 0), 1))", "w": "CASE WHEN l_quantity >= 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"}, digits=6)
lineitem("fn_sigmoid", {"v": "sigmoid(l_quantity, 25, 0.2)"}, {"v": "1 / (1 + exp(-0.2::DOUBLE * (l_quantity - 25)))"}, digits=6)
lineitem("fn_rounding", {"a": "floor(-l_extendedprice / 7)", "b": "ceil(l_extendedprice / 7)", "c": "round(l_quantity / 4 - 5)", "d": "trunc(10 - l_quantity / 3)", "e": "abs(l_tax - l_discount)"}, {"a": "floor(-l_extendedprice / 7) + 0", "b": "ceil(l_extendedprice / 7) + 0", "c": "round(l_quantity / 4 - 5) + 0", "d": "trunc(10 - l_quantity / 3) + 0", "e": "abs(l_tax - l_discount)"}, digits=9)
lineitem("fn_roots_exp_log", {"a": "sqrt(l_quantity)", "b": "cbrt(l_quantity)", "c": "pow(l_quantity, 1.5)", "d": "exp(l_tax)", "e": "exp2(l_tax)", "f": "log(l_quantity)", "g": "log10(l_quantity)", "h": "log2(l_quantity)"}, {"a": "sqrt(l_quantity)", "b": "cbrt(l_quantity)", "c": "pow(l_quantity, 1.5)", "d": "exp(l_tax)", "e": "pow(2, l_tax)", "f": "ln(l_quantity)", "g": "log10(l_quantity)", "h": "log2(l_quantity)"}, digits=6)
lineitem("fn_trig", {k: f"{k}(l_tax)" for k in ("sin", "cos", "tan", "asin", "acos", "atan")}, {k: f"{k}(l_tax)" for k in ("sin", "cos", "tan", "asin", "acos", "atan")}, digits=6)
lineitem("fn_atan2", {"v": "atan2(l_tax, l_discount - 0.05)"}, {"v": "atan2(l_tax, l_discount - 0.05::DOUBLE)"}, digits=6)
lineitem("fn_hyper", {k: f"{k}(l_tax)" for k in ("sinh", "cosh", "tanh")}, {k: f"{k}(l_tax)" for k in ("sinh", "cosh", "tanh")}, digits=6)
lineitem("fn_consts", {"v": "pi() * e() + min(0, inf())"}, {"v": "pi() * exp(1)"}, digits=6)
lineitem("fn_log_edges", {"a": "log(l_discount) == -inf()", "b": "log(-1) == log(-1)", "c": "pow(1, nan())"}, {"a": "l_discount = 0", "b": "false", "c": "1.0::DOUBLE"})


# Functions of the user's

def _defined() -> Engine:
    registry = standard()
    registry.define("net(p, d) => p * (1 - d)")
    registry.define("taxed(p, d, r) => net(p, d) * (1 + r)")
    registry.define("cheap(p) => p < 20000")
    return Engine(registry)


def _native() -> Engine:
    registry = standard()
    registry.add("sq", lambda x: x * x, 1)
    registry.add_nullary("answer", lambda: F.lit(42.0))
    registry.add_unary("half", lambda x: x / 2)
    registry.add_binary("hyp2", lambda x, y: x * x + y * y)
    registry.add_ternary("mid", lambda x, y, z: x + y + z - F.least(x, y, z) - F.greatest(x, y, z))
    registry.add_value("is_large", lambda x: x > 30, 1, BOOL)
    registry.add_typed("pick", lambda c, x, y: F.when(c, x).otherwise(y), [BOOL, NUMBER, NUMBER], NUMBER)
    registry.set_param_names("hyp2", ["left", "right"])
    return Engine(registry)


def _macros() -> Engine:
    registry = standard()
    registry.macro("twice", lambda call, compiler: t.Binary("*", t.Number(2.0), call.args[0]))

    def scaled(call, compiler):
        """abs(x, "percent") is in hundredths; other calls of abs are as they were."""
        if len(call.args) == 2 and call.args[1] == t.Text("percent"):
            return t.Binary("*", t.Number(100.0), t.Call("abs", call.args[:1], (None,)))
        return None

    registry.overlay("abs", scaled)
    return Engine(registry)


def _structs() -> Engine:
    registry = standard()
    registry.struct_function("distance2", lambda ax, ay, bx, by: (ax - bx) * (ax - bx) + (ay - by) * (ay - by), ["x", "y"], 2)
    registry.define("dot2(u, v) => u.x * v.x + u.y * v.y")
    registry.producer("band", lambda x, w: {"upper": x + w, "lower": x - w, "wide": w > F.lit(1.0)}, {"upper": NUMBER, "lower": NUMBER, "wide": BOOL}, 2, ("x", "w"))
    return Engine(registry)


lineitem("define_scalar", {"v": "net(l_extendedprice, l_discount)", "w": "taxed(l_extendedprice, l_discount, l_tax)", "c": "cheap(l_extendedprice)"}, {"v": "l_extendedprice * (1 - l_discount)", "w": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "c": "l_extendedprice < 20000"}, _defined)
lineitem("named_args", {"v": "net(d=l_discount, p=l_extendedprice)"}, {"v": "l_extendedprice * (1 - l_discount)"}, _defined)
lineitem("native_fns", {"a": "sq(l_quantity) + answer()", "b": "half(hyp2(right=l_tax, left=l_discount))", "c": "mid(l_tax, l_discount, 0.05)", "d": "is_large(l_quantity)", "e": "pick(is_large(l_quantity), l_tax, l_discount)"}, {"a": "l_quantity * l_quantity + 42", "b": "(l_discount * l_discount + l_tax * l_tax) / 2", "c": "median_of", "d": "l_quantity > 30", "e": "CASE WHEN l_quantity > 30 THEN l_tax ELSE l_discount END"}, _native)
_oracle["native_fns"] = _oracle["native_fns"].replace("median_of", "l_tax + l_discount + 0.05::DOUBLE - least(l_tax, l_discount, 0.05::DOUBLE) - greatest(l_tax, l_discount, 0.05::DOUBLE)")
lineitem("macros", {"v": "twice(l_tax)", "w": 'abs(l_tax - l_discount, "percent")', "x": "abs(l_tax - l_discount)"}, {"v": "2 * l_tax", "w": "100 * abs(l_tax - l_discount)", "x": "abs(l_tax - l_discount)"}, _macros)
lineitem("producer", {"v": "band(l_extendedprice, 2).upper", "w": "(band(w=l_tax, x=l_quantity)).lower", "b": "band(l_tax, 2).wide"}, {"v": "l_extendedprice + 2", "w": "l_quantity - l_tax", "b": "true"}, _structs)


def _points(spark: SparkSession, folder: str) -> DataFrame:
    x, y, net = F.col("l_quantity"), F.col("l_tax"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    a, b = F.struct(x.alias("x"), y.alias("y")), F.struct(F.lit(1.5).alias("x"), F.col("l_discount").alias("y"))
    return table(spark, folder, "lineitem").select(*KEYS, a.alias("a"), b.alias("b"), F.struct(F.struct(net.alias("net"), (net > 1000).alias("large")).alias("price")).alias("geo"))


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS v FROM lineitem")
def struct_field(spark: SparkSession, folder: str) -> DataFrame:
    return Engine().select(_points(spark, folder), KEYS, v="a.x + a.y")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS v, l_extendedprice * (1 - l_discount) > 1000 AS w FROM lineitem")
def chain(spark: SparkSession, folder: str) -> DataFrame:
    return Engine().select(_points(spark, folder), KEYS, v="geo.price.net", w="geo.price.large")


@query("SELECT l_orderkey, l_linenumber, (l_quantity - 1.5::DOUBLE) * (l_quantity - 1.5::DOUBLE) + (l_tax - l_discount) * (l_tax - l_discount) AS v FROM lineitem")
def struct_fn(spark: SparkSession, folder: str) -> DataFrame:
    return _structs().select(_points(spark, folder), KEYS, v="distance2(a, b)")


@query("SELECT l_orderkey, l_linenumber, l_quantity * 1.5::DOUBLE + l_tax * l_discount AS v FROM lineitem")
def define_struct(spark: SparkSession, folder: str) -> DataFrame:
    return _structs().select(_points(spark, folder), KEYS, v="dot2(a, b)")


@query("""
WITH a AS (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem),
b AS (SELECT *, net > 20000 AS trend, l_quantity < 25 AS pullback FROM a)
SELECT l_orderkey, l_linenumber, net, trend, pullback, trend AND pullback AS entry FROM b
""")
def named_set(spark: SparkSession, folder: str) -> DataFrame:
    expressions = {"entry": "trend and pullback", "trend": "net > $large", "pullback": "l_quantity < 25", "net": "l_extendedprice * (1 - l_discount)"}
    return Engine().with_params(large=20000).with_expressions(table(spark, folder, "lineitem"), expressions).select(*KEYS, *expressions)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 30000 AND l_quantity BETWEEN 20 AND 45 AND l_discount < 0.05")
def filter_pushdown(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem")
    return Engine().filter(df, "l_extendedprice > 30000 and l_quantity in [20, 45] and l_discount < 0.05").select(*KEYS, "l_extendedprice")


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_extendedprice * (1 - l_discount) > 20000) AS signals FROM lineitem GROUP BY l_returnflag")
def signal_count(spark: SparkSession, folder: str) -> DataFrame:
    return grouped.counted(Engine(), table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice * (1 - l_discount) > 20000")


# Series: events of a user in order of time

SERIES = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def series_query(name: str, expressions: dict[str, str], oracle: str, digits: int | None = None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = table(spark, folder, "events")
        engine = Engine().over("user_id", ["ts", "event_id"])
        columns = {k: engine.compile(df, text) for k, text in expressions.items()}
        return df.select("event_id", *[(F.round(v.column, digits) if digits is not None and v.type is NUMBER else v.column).alias(k) for k, v in columns.items()])

    _queries[name] = run
    _oracle[name] = oracle


series_query("lookback", {"v": "value[1]", "w": "value[0]"}, f"SELECT event_id, lag(value, 1) OVER w AS v, value AS w FROM events {SERIES}")
series_query("lookback_nested", {"v": "value[1][2]"}, f"SELECT event_id, lag(value, 3) OVER w AS v FROM events {SERIES}")
series_query("lookback_expr", {"v": "(value * 2)[1]", "w": "(value > value[1])[2]"}, f"SELECT event_id, lag(value, 1) OVER w * 2 AS v, lag(value, 2) OVER w > lag(value, 3) OVER w AS w FROM events {SERIES}")
series_query("lookback_dynamic", {"v": "value[user_id % 4]", "w": "(value * 2)[event_id % 3][1]"}, f"SELECT event_id, CASE user_id % 4 WHEN 0 THEN value WHEN 1 THEN lag(value, 1) OVER w WHEN 2 THEN lag(value, 2) OVER w ELSE lag(value, 3) OVER w END AS v, CASE lag(event_id, 1) OVER w % 3 WHEN 0 THEN lag(value, 1) OVER w WHEN 1 THEN lag(value, 2) OVER w WHEN 2 THEN lag(value, 3) OVER w END * 2 AS w FROM events {SERIES}")
series_query("rising_dynamic", {"v": "rising(value, 2 + user_id % 2)"}, f"SELECT event_id, CASE WHEN user_id % 2 = 0 THEN value > lag(value, 1) OVER w ELSE value > lag(value, 1) OVER w AND lag(value, 1) OVER w > lag(value, 2) OVER w END AS v FROM events {SERIES}")
series_query("rising", {"v": "rising(value, 3)"}, f"SELECT event_id, value > lag(value, 1) OVER w AND lag(value, 1) OVER w > lag(value, 2) OVER w AS v FROM events {SERIES}")
series_query("falling", {"v": "falling(value, 3)"}, f"SELECT event_id, value < lag(value, 1) OVER w AND lag(value, 1) OVER w < lag(value, 2) OVER w AS v FROM events {SERIES}")
ROWS5 = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
series_query("sma", {"v": "sma(value, 5)"}, f"SELECT event_id, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 6) END AS v FROM events WINDOW w AS {ROWS5}", 6)
series_query("bollinger", {"u": "bollinger(value, 5, 2).upper", "l": "bollinger(value, width=2, n=5).lower"}, f"SELECT event_id, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w + 2 * stddev_pop(value) OVER w, 6) END AS u, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w - 2 * stddev_pop(value) OVER w, 6) END AS l FROM events WINDOW w AS {ROWS5}", 6)
series_query("rsi", {"v": "rsi(value, 5)"}, f"""
WITH c AS (SELECT event_id, user_id, ts, value - lag(value) OVER w AS d FROM events {SERIES}),
s AS (SELECT event_id, count(d) OVER w AS n, sum(greatest(d, 0)) OVER w AS up, sum(greatest(-d, 0)) OVER w AS down FROM c WINDOW w AS {ROWS5})
SELECT event_id, CASE WHEN n = 5 THEN CASE WHEN down = 0 THEN 100 ELSE round(100 - 100 / (1 + up / nullif(down, 0)), 6) END END AS v FROM s
""", 6)  # fmt: skip


@query(f"""
WITH a AS (SELECT *, CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END AS sma5 FROM events WINDOW w AS {ROWS5})
SELECT event_id, value > sma5 AND lag(value) OVER w <= lag(sma5) OVER w AS v FROM a {SERIES}
""")
def cross_above(spark: SparkSession, folder: str) -> DataFrame:
    engine = Engine().over("user_id", ["ts", "event_id"])
    df = engine.with_expressions(table(spark, folder, "events"), {"sma5": "sma(value, 5)", "v": "value > sma5 and value[1] <= sma5[1]"})
    return df.select("event_id", "v")


@query("""
WITH RECURSIVE o AS (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
e AS (
  SELECT event_id, user_id, k, value AS ema FROM o WHERE k = 1
  UNION ALL SELECT o.event_id, o.user_id, o.k, CASE WHEN o.value IS NULL THEN e.ema WHEN e.ema IS NULL THEN o.value ELSE e.ema + (2.0::DOUBLE / 6) * (o.value - e.ema) END FROM e JOIN o ON o.user_id = e.user_id AND o.k = e.k + 1)
SELECT event_id, round(ema, 6) AS ema FROM e
""")
def ema_nulls(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return series.ema(df, ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", F.round("ema", 6).alias("ema"))


@query("""
WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
e AS (
  SELECT event_id, user_id, k, value AS ema FROM o WHERE k = 1
  UNION ALL SELECT o.event_id, o.user_id, o.k, e.ema + (2.0::DOUBLE / 6) * (o.value - e.ema) FROM e JOIN o ON o.user_id = e.user_id AND o.k = e.k + 1)
SELECT event_id, round(ema, 6) AS ema FROM e
""")
def ema(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    return series.ema(df, ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", F.round("ema", 6).alias("ema"))


# Baskets

def basket(name: str, expressions: dict[str, str], oracle: dict[str, str]) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = table(spark, folder, "embeddings")
        engine = Engine(standard(with_baskets=True)).with_params(role=F.col("embedding"), pair=[1, 2, 3], single=[4])
        columns = {k: engine.compile(df, text) for k, text in expressions.items()}
        return df.select("vec_id", *[(F.round(v.column, 5) if v.type is NUMBER else v.column).alias(k) for k, v in columns.items()])

    _queries[name] = run
    sql = ", ".join(f"{'' if ' bool' in k else 'round('}{text}{'' if ' bool' in k else ', 5)'} AS {k.split()[0]}" for k, text in oracle.items())
    _oracle[name] = f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings) SELECT vec_id, {sql} FROM v"


basket("basket_avg", {"v": "avg($role * 2)", "w": "avg($pair)", "s": "avg($single) + avg(1, 2, 6)"}, {"v": "list_avg(list_transform(x, lambda y: y * 2))", "w": "2.0::DOUBLE", "s": "7.0::DOUBLE"})
basket("basket_min", {"v": "min($role)", "w": "min(2, 1)"}, {"v": "list_min(x)", "w": "1.0::DOUBLE"})
basket("basket_max", {"v": "max(abs($role))"}, {"v": "list_max(list_transform(x, lambda y: abs(y)))"})
basket("basket_any", {"v": "any($role > 0.3)"}, {"v bool": "len(list_filter(x, lambda y: y > 0.3::DOUBLE)) > 0"})
basket("basket_all", {"v": "all($role < 0.3)"}, {"v bool": "len(list_filter(x, lambda y: y < 0.3::DOUBLE)) = len(x)"})
basket("basket_count", {"v": "count($role)", "w": "avg($role - avg($pair))"}, {"v": "len(x)::DOUBLE", "w": "list_avg(x) - 2"})


@query("""
SELECT user_id, round(avg(value * 2), 6) AS a, min(value) AS lo, max(value) AS hi, bool_or(value > 90) AS some, bool_and(value > 0) AS every, count(*)::DOUBLE AS n
FROM events GROUP BY user_id
""")
def basket_groupby(spark: SparkSession, folder: str) -> DataFrame:
    df = Engine().aggregate(table(spark, folder, "events"), ["user_id"], a="avg(value * 2)", lo="min(value)", hi="max(value)", some="any(value > 90)", every="all(value > 0)", n="count(value)")
    return df.withColumn("a", F.round("a", 6))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)
