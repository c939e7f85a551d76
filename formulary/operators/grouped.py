"""Basket aggregates over rows: a role in long format, one row for each value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulary.errors import TypeMismatch, UnknownIdentifier
from formulary.functions.baskets import NAMES
from formulary.plans import parser
from formulary.plans import tree as t
from formulary.plans.types import BOOL, NUMBER, Value


def aggregated(engine, df: DataFrame, keys: Sequence[str], expressions: Mapping[str, str]) -> DataFrame:
    """One row for each key. Each expression is an aggregate, such as ``any(value > 3)``, of an expression of the rows.

    Spark aggregates within tasks first. Without rows there is no group, so the
    question of an empty basket does not arise.
    """
    compiler = engine.compiler(df)
    return df.groupBy(*keys).agg(*[_column(parser.parse(text), compiler).alias(name) for name, text in expressions.items()])


def _column(node: t.Node, compiler) -> Column:
    if not isinstance(node, t.Call) or node.name not in NAMES or len(node.args) != 1:
        raise UnknownIdentifier(f"An aggregate of one argument is needed: {', '.join(NAMES)}")
    if node.name == "count":
        return F.count(F.lit(1)).cast("double")
    value: Value = compiler.value(node.args[0])
    if node.name in ("any", "all"):
        truth = value.column if value.type is BOOL else value.column != 0
        return (F.bool_or if node.name == "any" else F.bool_and)(truth)
    if value.type is not NUMBER:
        raise TypeMismatch(f"{node.name}() folds numbers")
    return {"avg": F.avg, "min": F.min, "max": F.max}[node.name](value.column)


def counted(engine, df: DataFrame, keys: Sequence[str], predicate: str, output: str = "signals") -> DataFrame:
    """How many rows of each key, or of all, a predicate holds for."""
    return df.groupBy(*keys).agg(F.count_if(engine.compiler(df).predicate(parser.parse(predicate)).column).alias(output))
