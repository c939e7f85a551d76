"""Operators along an ordered series: trends, moving indicators, recurrences.

A series is a window: rows of one key in an order without ties. Everything here
but ``scan`` and ``ema`` is native and shares one sort with the lookbacks of an expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from formulary.errors import ExpressionSyntaxError, WrongArity
from formulary.functions.registry import Registry
from formulary.plans import tree as t
from formulary.plans.compiler import checked
from formulary.plans.types import BOOL, NUMBER, Value


def ordered(keys: Sequence[str] | str, order: Sequence[str] | str) -> WindowSpec:
    """The window of a series; the order must have no ties."""
    as_list = lambda x: [x] if isinstance(x, str) else list(x)
    return W.partitionBy(*as_list(keys)).orderBy(*as_list(order))


def trend(name: str, step: str):
    """Every one of n values greater (or less) than the one before it; n is 2 or more."""

    def expand(call: t.Call, compiler) -> Value:
        if len(call.args) != 2:
            raise WrongArity(f"'{name}' takes a value and a number of rows")
        value, rows = call.args
        count = compiler.number(rows)
        n = count.constant
        if n is not None and (n != n or abs(n) == float("inf") or abs(n - round(n)) > 1e-9 or round(n) < 2):
            raise ExpressionSyntaxError(f"'{name}' looks at a whole number of rows, 2 or more")
        most = round(n) if n is not None else compiler.most_back + 1
        out = None
        for i in range(most - 1):
            now = t.Lookback(value, t.Number(float(i))) if i else value
            pair = t.Binary(step, now, t.Lookback(value, t.Number(float(i + 1))))
            if n is None:  # rows beyond those asked for do not count
                pair = t.Ternary(t.Binary("<", rows, t.Number(i + 1.5)), t.Bool(True), pair)
            out = pair if out is None else t.Binary("and", out, pair)
        found = compiler.compile(out)
        if n is not None:
            return Value(found.column, BOOL, False, found.raises)
        k = count.column
        valid = (k >= 1.5) & (k <= most) & (F.abs(k - F.rint(k)) <= 1e-9)
        return Value(F.when(k.isNotNull(), checked(valid, found.column, T.BooleanType(), f"'{name}' looks at a whole number of rows, from 2 to {most}")), BOOL, False, True)

    return expand


rising, falling = trend("rising", ">"), trend("falling", "<")


def _moving(args: tuple[t.Node, ...], compiler) -> tuple[Column, WindowSpec, int]:
    """Value, the last n rows, and n. Where the values are read further back, so are all of the n."""
    if compiler.window is None:
        raise ExpressionSyntaxError("A moving value needs an ordered series")
    n = round(compiler.constant_number(args[1]))
    if n < 1:
        raise ExpressionSyntaxError("A moving value needs 1 row or more")
    return compiler.number(args[0]).column, compiler.window.rowsBetween(1 - n, 0), n


def _full(column: Column, value: Column, rows: WindowSpec, n: int) -> Column:
    """NULL until n values are there, as with any lookback beyond the first row."""
    return F.when(F.count(value).over(rows) == n, column)


def moving_average(args, compiler) -> dict[str, Column]:
    value, rows, n = _moving(args, compiler)
    return {"value": _full(F.avg(value).over(rows), value, rows, n)}


def bollinger(args, compiler) -> dict[str, Column]:
    """Average of n values, and that plus and minus a number of population deviations."""
    value, rows, n = _moving(args[:2], compiler)
    width = compiler.constant_number(args[2]) * F.stddev_pop(value).over(rows)
    middle = F.avg(value).over(rows)
    return {k: _full(c, value, rows, n) for k, c in {"upper": middle + width, "middle": middle, "lower": middle - width}.items()}


def relative_strength(args, compiler) -> dict[str, Column]:
    """100 - 100 / (1 + gains / losses) over the last n changes; 100 without a loss."""
    _, rows, n = _moving(args, compiler)
    change = compiler.number(t.Binary("-", args[0], t.Lookback(args[0], t.Number(1.0)))).column
    up, down = F.sum(F.greatest(change, F.lit(0.0))).over(rows), F.sum(F.greatest(-change, F.lit(0.0))).over(rows)
    return {"value": F.when(F.count(change).over(rows) == n, F.when(down == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + up / F.nullif(down, F.lit(0.0)))))}


def register(registry: Registry) -> None:
    """sma(x, n), rsi(x, n) and bollinger(x, n, width).upper, .middle, .lower."""

    def single(build):
        def expand(call: t.Call, compiler) -> Value:
            if len(call.args) != 2:
                raise WrongArity(f"'{call.name}' takes a value and a number of rows")
            return Value(build(call.args, compiler)["value"], NUMBER)

        return expand

    registry.timeseries("sma", single(moving_average))
    registry.timeseries("rsi", single(relative_strength))
    registry.producer("bollinger", bollinger, ("upper", "middle", "lower"), 3, ("x", "n", "width"), series=True)


def runs(batch: pa.RecordBatch, keys: Sequence[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """The number of each row's run of equal keys, 0 where it goes on from the batch before; and the last row's keys."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for name in keys:
        code = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    key = lambda i: tuple(batch.column(name)[i].as_py() for name in keys)
    new[0] = last is None or key(0) != last
    return np.cumsum(new), key(batch.num_rows - 1)


def added(df: DataFrame, outputs: dict[str, str]) -> list[T.StructField]:
    return df.select(*[F.lit(None).cast(kind).alias(name) for name, kind in outputs.items()]).schema.fields


def along(df: DataFrame, keys: Sequence[str], order: Sequence[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], outputs: dict[str, str]) -> DataFrame:
    """Sorted partitions, streamed through a function of Arrow batches that adds columns."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, T.StructType([*df.schema.fields, *added(df, outputs)]))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], dict], step: Callable[[dict, dict], dict], outputs: dict[str, str]) -> DataFrame:
    """A recurrence along each series: ``step(state, row)`` gives the next state, whose entries become columns.

    For what no window can say and what has no form of its own here, as it calls
    ``step`` for each row; a row is a dict of plain values, NULL is None. Rows are
    sorted within partitions and streamed, so that a task holds one state, however
    long a series is; a series is one task's work, as its order demands. The columns
    of ``df`` go through unchanged.
    """
    keys, order = list(keys), list(order)
    kinds = {f.name: to_arrow_type(f.dataType) for f in added(df, outputs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            run_of, key = runs(batch, keys, last)
            found: dict[str, list] = {name: [] for name in outputs}
            before = 0
            for now, row in zip(run_of.tolist(), batch.to_pylist(), strict=True):
                if now != before:
                    state, before = start(), now
                state = step(state, row)
                for name in outputs:
                    found[name].append(state[name])
            last = key
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(found[name], kinds[name]) for name in outputs]], [*batch.schema.names, *outputs])

    return along(df, keys, order, run, outputs)


def averaged(x: np.ndarray, missing: np.ndarray, run_of: np.ndarray, weight: float, carried: float | None) -> np.ndarray:
    """Exponential averages of runs of values; run 0 goes on from what is carried. Missing values leave them as they are."""
    ahead = carried is not None
    values, own = np.r_[carried, x] if ahead else x, np.r_[0, run_of] if ahead else run_of
    broken = np.isnan(values) & ~(np.r_[False, missing] if ahead else missing)
    series = pd.Series(np.where(np.isfinite(values), values, np.nan))
    out = series.groupby(own).ewm(alpha=weight, adjust=False, ignore_na=True).mean().to_numpy()
    if (broken | np.isinf(values)).any():  # IEEE: NaN stays, and so do infinities until one of the other sign
        lost = pd.Series(broken).groupby(own).cummax().to_numpy()
        after = pd.Series(np.where(np.isinf(values), values, 0.0)).groupby(own).cumsum().to_numpy()
        out = np.where(lost, np.nan, np.where(np.isfinite(after), out, after))
    return out[1:] if ahead else out


def ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int, output: str = "ema") -> DataFrame:
    """Exponential moving average with weight 2 / (n + 1); the first value starts it.

    A NULL leaves the average as it was, and is NULL where nothing came before; after
    a NaN everything is NaN. Batches are computed whole, in Arrow.
    """
    weight, keys = 2.0 / (n + 1), list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            run_of, key = runs(batch, keys, last)
            column = batch.column(value).cast(pa.float64(), safe=False)
            missing = column.is_null().to_numpy(zero_copy_only=False)
            found = averaged(np.where(missing, np.nan, column.to_numpy(zero_copy_only=False)), missing, run_of, weight, carried if run_of[0] == 0 else None)
            # NULL until a run's first value, which may have come with the batch before.
            seen = pd.Series(~missing).groupby(run_of).cummax().to_numpy() | ((run_of == 0) & (carried is not None))
            last, carried = key, float(found[-1]) if seen[-1] else None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, mask=~seen)], [*batch.schema.names, output])

    return along(df, keys, list(order), run, {output: "double"})


__all__ = ["bollinger", "ema", "falling", "ordered", "register", "rising", "scan"]
