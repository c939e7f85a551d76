"""Sets of named expressions that may use one another."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from formulary.errors import CircularDependency
from formulary.plans import analysis, parser
from formulary.plans import tree as t


@dataclass
class ExpressionSet:
    """Expressions in order of addition; they are evaluated in order of dependence."""

    nodes: dict[str, t.Node] = field(default_factory=dict)

    def add(self, name: str, text: str) -> None:
        self.nodes = {**self.nodes, name: parser.parse(text)}

    def add_all(self, expressions: Mapping[str, str]) -> None:
        """All of them, or none if one does not parse."""
        self.nodes = {**self.nodes, **{name: parser.parse(text) for name, text in expressions.items()}}

    def needs(self, name: str) -> list[str]:
        """Other expressions that an expression uses, whole or by field."""
        used = {r.split(".")[0] for r in analysis.references(self.nodes[name])}
        return [other for other in self.nodes if other in used]

    def levels(self) -> list[list[str]]:
        """Expressions by the number of steps that they depend on, each level in order of addition."""
        left = {name: set(self.needs(name)) for name in self.nodes}
        out: list[list[str]] = []
        while left:
            ready = [name for name, needs in left.items() if not needs & left.keys()]
            if not ready:
                raise CircularDependency(f"Circular dependency among {', '.join(left)}")
            out.append(ready)
            left = {name: needs for name, needs in left.items() if name not in ready}
        return out

    def order(self) -> list[str]:
        """First come, first served: an expression follows when the last that it needs is done."""
        needs = {name: set(self.needs(name)) for name in self.nodes}
        waiting = [name for name in self.nodes if not needs[name]]
        done: list[str] = []
        while waiting:
            name = waiting.pop(0)
            done.append(name)
            for other in self.nodes:
                if name in needs[other]:
                    needs[other].discard(name)
                    if not needs[other]:
                        waiting.append(other)
        if len(done) < len(self.nodes):
            raise CircularDependency(f"Circular dependency among {', '.join(n for n in self.nodes if n not in done)}")
        return done

    def analyze(self, engine, df: DataFrame | None = None) -> tuple[dict[str, analysis.Analysis], list[str]]:
        compiler = engine.compiler(df) if df is not None else None
        return {name: analysis.analyze(node, engine.registry, compiler, self.nodes) for name, node in self.nodes.items()}, self.order()

    def applied(self, engine, df: DataFrame) -> DataFrame:
        """``df`` with a column for each expression, one projection for each level; all are checked before."""
        for level in self.levels():
            compiler = engine.compiler(df)
            df = df.withColumns({name: compiler.value(self.nodes[name]).column for name in level})
        return df
