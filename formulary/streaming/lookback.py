"""Expressions over streams.

Expressions of one row, sets of named expressions and filters apply to a streaming
DataFrame as they are. Lookback needs earlier rows, which Spark's windows do not
give on streams: a state of the last rows of each key, as many as the largest
offset, supplies them, and the expressions themselves stay native.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formulary.plans import parser
from formulary.plans.compiler import Compiler


WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def lag_name(name: str, back: int) -> str:
    return f"__{name}_back_{back}"


def with_lookback(engine, stream: DataFrame, keys: Sequence[str], order: str, expressions: Mapping[str, str]) -> DataFrame:
    """The stream's rows with a column for each expression; lookback runs along ``order`` within ``keys``.

    Whole numbers are handed on as text, so that none changes where a column has NULLs.
    Rows of a batch are sorted by ``order``; a row that arrives after a later one of
    its key counts as following it.
    """
    wanted: set[tuple[str, int]] = set()

    def recorded(column: Column, name: str, back: int) -> Column:
        wanted.add((name, back))
        return F.col(f"`{lag_name(name, back)}`")

    compiler = Compiler(stream.schema, engine.registry, engine.params, None, recorded, engine.on_zero)
    compiled = {name: compiler.value(parser.parse(text)).column for name, text in expressions.items()}
    lagged = _with_lags(stream, list(keys), order, sorted(wanted)) if wanted else stream
    return lagged.select(*stream.columns, *[column.alias(name) for name, column in compiled.items()])


def _with_lags(stream: DataFrame, keys: list[str], order: str, wanted: list[tuple[str, int]]) -> DataFrame:
    depth = max(back for _, back in wanted)
    names = sorted({name for name, _ in wanted})
    given = stream.schema
    whole = {f.name for f in given.fields if isinstance(f.dataType, WHOLE)}
    stream = stream.select([F.col(f"`{c}`").cast("string").alias(c) if c in whole else F.col(f"`{c}`") for c in stream.columns])
    rank = (lambda s: s.map(lambda x: -math.inf if x is None else int(x))) if order in whole else None
    out = T.StructType([*stream.schema.fields, *[T.StructField(lag_name(n, k), stream.schema[n].dataType) for n, k in wanted]])
    state_schema = T.StructType([T.StructField(n, T.ArrayType(stream.schema[n].dataType)) for n in names])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else tuple([] for _ in names)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable", key=rank, na_position="first").reset_index(drop=True)
        added = {}
        last = []
        for name, held in zip(names, kept, strict=True):
            values = [*held, *rows[name].tolist()]
            for n, back in wanted:
                if n == name:
                    at = len(held) - back
                    added[lag_name(n, back)] = [values[at + i] if at + i >= 0 else None for i in range(len(rows))]
            last.append(values[-depth:])
        state.update(tuple(last))
        yield rows.assign(**added)[[f.name for f in out.fields]]

    found = stream.groupBy(*keys).applyInPandasWithState(run, out, state_schema, "append", "NoTimeout")
    kinds = {f.name: f.dataType for f in given.fields} | {lag_name(n, k): given[n].dataType for n, k in wanted}
    return found.select([F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in found.columns])


def stream_table(spark, folder: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).load(folder)
