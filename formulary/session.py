"""The engine that users hold: functions, parameters and the order of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, WindowSpec

from formulary.functions import baskets, library
from formulary.functions.registry import Registry
from formulary.operators import grouped, series
from formulary.plans import analysis, parser
from formulary.plans import tree as t
from formulary.plans.compiler import Compiler
from formulary.plans.dag import ExpressionSet
from formulary.plans.types import Value


def standard(with_baskets: bool = False) -> Registry:
    """The default functions and moving indicators; basket aggregates replace min and max where asked for."""
    registry = library.defaults()
    series.register(registry)
    if with_baskets:
        baskets.register(registry)
    return registry


@dataclass(frozen=True)
class Engine:
    registry: Registry = field(default_factory=standard)
    params: Mapping[str, object] = field(default_factory=dict)
    window: WindowSpec | None = None
    on_zero: str = "error"
    #: Whether a lookback beyond the first row is an error, not NULL.
    strict: bool = False
    #: Rows that a lookback, or a trend, may go back where their number is no constant.
    most_back: int = 64

    def with_params(self, **params) -> Engine:
        """Values of $names; a dotted name is given as ``**{"a.b": 1}``, a role as a list or an array column."""
        return replace(self, params={**self.params, **params})

    def over(self, keys: Sequence[str] | str, order: Sequence[str] | str) -> Engine:
        """With lookback along rows of equal keys, in an order without ties."""
        return replace(self, window=series.ordered(keys, order))

    def compiler(self, df: DataFrame) -> Compiler:
        return Compiler(df.schema, self.registry, self.params, self.window, on_zero=self.on_zero, strict=self.strict, most_back=self.most_back)

    def compile(self, df: DataFrame, text: str | t.Node) -> Value:
        return self.compiler(df).value(parser.parse(text) if isinstance(text, str) else text)

    def column(self, df: DataFrame, text: str) -> Column:
        """An expression of any type, as a column of ``df``."""
        return self.compile(df, text).column

    def number(self, df: DataFrame, text: str) -> Column:
        return self.compiler(df).number(parser.parse(text)).column

    def predicate(self, df: DataFrame, text: str) -> Column:
        return self.compiler(df).predicate(parser.parse(text)).column

    def at_offset(self, df: DataFrame, text: str, back: int) -> Column:
        """The whole expression as of ``back`` rows earlier."""
        return self.compiler(df).compile(t.Lookback(parser.parse(text), t.Number(float(back)))).column

    def select(self, df: DataFrame, keep: Sequence[str] = (), **expressions: str) -> DataFrame:
        return df.select(*keep, *[self.column(df, text).alias(name) for name, text in expressions.items()])

    def filter(self, df: DataFrame, text: str) -> DataFrame:
        return df.where(self.predicate(df, text))

    def with_expressions(self, df: DataFrame, expressions: Mapping[str, str] | ExpressionSet) -> DataFrame:
        """``df`` with named expressions, which may use one another in any order."""
        if not isinstance(expressions, ExpressionSet):
            named = ExpressionSet()
            named.add_all(expressions)
            expressions = named
        return expressions.applied(self, df)

    def aggregate(self, df: DataFrame, keys: Sequence[str], **expressions: str) -> DataFrame:
        """Basket aggregates over the rows of each key."""
        return grouped.aggregated(self, df, keys, expressions)

    def analyze(self, text: str, df: DataFrame | None = None) -> analysis.Analysis:
        return analysis.analyze(parser.parse(text), self.registry, self.compiler(df) if df is not None else None)

    def explain(self, df: DataFrame, text: str) -> str:
        """The expression as parsed, and the column that it becomes."""
        node = parser.parse(text)
        return f"{t.render(node)}\n=> {self.compiler(df).value(node).column}"
