"""The default functions, as builders of native columns.

Numbers are doubles with IEEE meaning: comparisons with NaN are false, and the
library functions give what C's give. NULL, which the language does not have,
comes out of every function that gets it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from formulary.functions.registry import Registry



def nan() -> Column:
    return F.lit(float("nan"))


def less(a: Column, b: Column) -> Column:
    """a < b as IEEE has it; Spark takes NaN for the largest number."""
    return (a < b) & ~F.isnan(b)


def any_null(*columns: Column) -> Column:
    return reduce(lambda x, y: x | y, (c.isNull() for c in columns))


def fold_least(*columns: Column) -> Column:
    """The first, replaced by each smaller one in turn: NaN stays only if it comes first."""
    folded = reduce(lambda out, c: F.when(less(c, out), c).otherwise(out), columns)
    return folded if len(columns) == 1 else F.when(~any_null(*columns), folded)


def fold_greatest(*columns: Column) -> Column:
    folded = reduce(lambda out, c: F.when(less(out, c), c).otherwise(out), columns)
    return folded if len(columns) == 1 else F.when(~any_null(*columns), folded)


def clamp(x: Column, low: Column, high: Column) -> Column:
    """Bounds in the wrong order are exchanged."""
    swapped = less(high, low)
    a, b = F.when(swapped, high).otherwise(low), F.when(swapped, low).otherwise(high)
    return F.when(~any_null(x, low, high), F.when(less(x, a), a).when(less(b, x), b).otherwise(x))


def whole(x: Column, cut: Column) -> Column:
    """Spark's floor and ceil are of 64 bits; what is larger than 2^52 has no fraction anyway."""
    return F.when(F.isnan(x) | (F.abs(x) >= float(2**52)), x).otherwise(cut.cast("double"))


def floor(x: Column) -> Column:
    return whole(x, F.floor(x))


def ceil(x: Column) -> Column:
    return whole(x, F.ceil(x))


def trunc(x: Column) -> Column:
    return whole(x, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))


def rounded(x: Column) -> Column:
    """Halves away from zero."""
    return whole(x, F.round(x))


def logarithm(x: Column, log: Column) -> Column:
    return F.when(x > 0, log).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), nan())


def power(base: Column, exponent: Column) -> Column:
    """1 to any power is 1, and so is -1 to an infinite one."""
    one = (base == 1) | ((base == -1) & (F.abs(exponent) == F.lit(float("inf"))))
    return F.when(one & exponent.isNotNull(), F.lit(1.0)).otherwise(F.pow(base, exponent))


def sign(x: Column) -> Column:
    return F.when(less(F.lit(0.0), x) & ~F.isnan(x), F.lit(1.0)).when(x < 0, F.lit(-1.0)).when(x.isNotNull(), F.lit(0.0))


def smoothstep(x: Column, low: Column, high: Column) -> Column:
    """A step at ``high`` where the edges are equal."""
    step = F.when(less(x, high) | F.isnan(x) | F.isnan(high), F.lit(0.0)).otherwise(F.lit(1.0))
    width = F.nullif(high - low, F.lit(0.0))
    s = clamp((x - low) / width, F.lit(0.0), F.lit(1.0))
    return F.when(~any_null(x, low, high), F.when((low == high) & ~F.isnan(low), step).otherwise(s * s * (3.0 - 2.0 * s)))


def sigmoid(x: Column, center: Column, steepness: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-steepness * (x - center)))


def defaults() -> Registry:
    r = Registry()
    r.add("min", fold_least, (1, 8))
    r.add("max", fold_greatest, (1, 8))
    r.add("clamp", clamp, 3, makes_nan=False)
    r.add("sign", sign, 1, makes_nan=False)
    r.add("lerp", lambda a, b, s: a + (b - a) * s, 3)
    r.add("smoothstep", smoothstep, 3)
    r.add("sigmoid", sigmoid, 3)
    r.add_unary("abs", F.abs)
    r.add_unary("floor", floor)
    r.add_unary("ceil", ceil)
    r.add_unary("round", rounded)
    r.add_unary("trunc", trunc)
    r.add_unary("sqrt", F.sqrt)
    r.add_unary("cbrt", F.cbrt)
    r.add_binary("pow", power)
    r.add_unary("exp", F.exp)
    r.add_unary("exp2", lambda x: F.pow(F.lit(2.0), x))
    r.add_unary("log", lambda x: logarithm(x, F.ln(x)))
    r.add_unary("log10", lambda x: logarithm(x, F.log10(x)))
    r.add_unary("log2", lambda x: logarithm(x, F.log2(x)))
    for name in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh"):
        r.add_unary(name, getattr(F, name))
    r.add_binary("atan2", F.atan2)
    r.add("pi", lambda: F.lit(math.pi), 0, makes_nan=False)
    r.add("e", lambda: F.lit(math.e), 0, makes_nan=False)
    r.add_nullary("nan", nan)
    r.add_nullary("inf", lambda: F.lit(float("inf")))  # differences of infinities are NaN
    # Special forms know the call's syntax; see the compiler and the series operators.
    from formulary.operators import series

    r.macro("if", _choice)
    r.timeseries("rising", series.rising)
    r.timeseries("falling", series.falling)
    return r


def _choice(call, compiler):
    return compiler.choice(call)
