"""Aggregates over the values bound to a role.

A role is an array: a list parameter, or an array column of the row. ``avg($role *
2)`` evaluates its argument for every value and folds the results, inside the row,
by higher-order functions. Over rows in long format, see ``operators.grouped``.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from formulary.errors import TypeMismatch, UnknownIdentifier
from formulary.functions import library
from formulary.functions.registry import Registry
from formulary.plans import tree as t
from formulary.plans.types import BOOL, NUMBER, Array, Value

NAMES = ("avg", "min", "max", "any", "all", "count")
FOLDS = ("avg", "min", "max")


def is_aggregate(name: str) -> bool:
    return name in NAMES


def uses_aggregates(node: t.Node) -> bool:
    """Whether a basket aggregate over a role is called anywhere."""
    return any(isinstance(n, t.Call) and n.name in NAMES and any(isinstance(m, t.Param) for m in n.walk()) for n in node.walk())


def free_roles(node: t.Node, compiler) -> list[str]:
    """Roles of the argument that no aggregate within it expands already."""
    if isinstance(node, t.Call) and node.name in NAMES and len(node.args) == 1:
        return []
    if isinstance(node, t.Param):
        return [node.name] if f"${node.name}" not in compiler.scope and isinstance(compiler.param(node.name).type, Array) else []
    return list(dict.fromkeys(r for child in node.children() for r in free_roles(child, compiler)))


def truth(value: Value) -> Column:
    return value.column if value.type is BOOL else value.column != 0


def fold(name: str, values: list[Value]) -> Value:
    """Of arguments given one by one."""
    if any(v.type is not NUMBER for v in values):
        raise TypeMismatch(f"{name}() folds numbers")
    columns = [v.column for v in values]
    if name == "avg":
        column = reduce(lambda a, b: a + b, columns) / len(columns)
    else:
        column = (library.fold_least if name == "min" else library.fold_greatest)(*columns)
    return Value(column, NUMBER, True, any(v.raises for v in values))


def aggregate(call: t.Call, compiler) -> Value:
    name = call.name
    if len(call.args) != 1:
        if name in FOLDS and len(call.args) > 1:
            return fold(name, [compiler.compile(a) for a in call.args])
        raise UnknownIdentifier("An aggregate over a role takes one argument")
    (arg,) = call.args
    if name == "count":
        if not isinstance(arg, t.Param):
            raise UnknownIdentifier("'count' takes a role, such as $pair")
        bound = compiler.param(arg.name)
        return Value(F.size(bound.column).cast("double") if isinstance(bound.type, Array) else F.lit(1.0), NUMBER, False)
    roles = free_roles(arg, compiler)
    if not roles:
        return compiler.compile(arg)
    if len(roles) > 1:
        raise UnknownIdentifier("An aggregate goes over one role, not several")
    (role,) = roles
    values = compiler.param(role).column
    seen: list[Value] = []

    def body(x: Column) -> Column:
        inner = replace(compiler, scope={**compiler.scope, f"${role}": Value(x, NUMBER)}, memo={})
        value = inner.compile(arg)
        seen.append(value)
        if name in ("any", "all"):
            return truth(value)
        if value.type is not NUMBER:
            raise TypeMismatch(f"{name}() folds numbers")
        return value.column

    results = F.transform(values, body)
    kind = BOOL if name in ("any", "all") else NUMBER
    if name == "any":
        column = F.exists(results, lambda x: x)
    elif name == "all":
        # Without values both are 0, which here is false.
        column = F.forall(results, lambda x: x) & (F.size(values) > 0)
    elif name == "avg":
        column = F.aggregate(results, F.lit(0.0), lambda a, b: a + b) / F.greatest(F.size(values), F.lit(1))
    else:
        smaller = (lambda a, b: library.less(b, a)) if name == "min" else (lambda a, b: library.less(a, b))
        rest = F.slice(results, 2, F.greatest(F.size(results) - 1, F.lit(0)))
        column = F.coalesce(F.aggregate(rest, F.get(results, 0), lambda a, b: F.when(smaller(a, b), b).otherwise(a)), F.when(F.size(values) == 0, 0.0))
    return Value(column, kind, kind is NUMBER, any(v.raises for v in seen))


def register(registry: Registry) -> None:
    """Takes the place of the default min and max."""
    for name in NAMES:
        registry.macro(name, aggregate)
