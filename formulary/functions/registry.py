"""Functions that expressions may call, and how each is registered."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from formulary.errors import ExpressionSyntaxError, UnknownFunction, WrongArity
from formulary.plans import parser
from formulary.plans import tree as t
from formulary.plans.types import BOOL, NUMBER, Struct, Type

MAX_FIELDS, MAX_STRUCT_PARAM_FIELDS, MAX_PARAMS = 64, 32, 16
HEADER = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*\(([^()]*)\)\s*=>(.*)", re.DOTALL)
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Producer:
    """Scalars in, named fields out."""

    build: Callable[..., dict[str, Column]]
    fields: tuple[tuple[str, Type], ...]
    arity: tuple[int, int]
    #: Whether ``build`` takes (args, compiler) with syntax, so that it can shift and order rows.
    series: bool = False


@dataclass(frozen=True)
class StructFunction:
    """Takes whole structs, spread into the listed fields."""

    build: Callable[..., Column]
    fields: tuple[str, ...]
    args: int
    returns: Type


@dataclass(frozen=True)
class Defined:
    """A body in the language; parameters used with fields are structs."""

    params: tuple[str, ...]
    body: t.Node


@dataclass(frozen=True)
class Entry:
    name: str
    #: Builds a column from columns.
    scalar: Callable[..., Column] | None = None
    arity: tuple[int, int] = (0, 0)
    returns: Type = NUMBER
    arg_types: tuple[Type, ...] | None = None
    params: tuple[str, ...] = ()
    #: Result may be NaN though no argument is.
    makes_nan: bool = True
    macro: Callable | None = None
    overlay: Callable | None = None
    producer: Producer | None = None
    struct: StructFunction | None = None
    defined: Defined | None = None


@dataclass
class Registry:
    entries: dict[str, Entry] = field(default_factory=dict)
    #: Counts changes, so that compiled expressions can tell whether they are stale.
    version: int = 0

    def _put(self, entry: Entry) -> None:
        self.entries[entry.name] = entry
        self.version += 1

    def add(self, name: str, build: Callable[..., Column], arity: int | tuple[int, int], returns: Type = NUMBER, params: Sequence[str] = (), makes_nan: bool = True) -> None:
        """A function of numbers; ``build`` takes and returns columns, so that it stays in generated code."""
        bounds = (arity, arity) if isinstance(arity, int) else arity
        old = self.entries.get(name)
        produced = old.producer if old else None
        self._put(Entry(name, build, bounds, returns, None, tuple(params) or (old.params if produced else ()), makes_nan, producer=produced))

    def add_nullary(self, name: str, build: Callable[[], Column]) -> None:
        self.add(name, build, 0)

    def add_unary(self, name: str, build: Callable[[Column], Column]) -> None:
        self.add(name, build, 1)

    def add_binary(self, name: str, build: Callable[[Column, Column], Column]) -> None:
        self.add(name, build, 2)

    def add_ternary(self, name: str, build: Callable[[Column, Column, Column], Column]) -> None:
        self.add(name, build, 3)

    def add_value(self, name: str, build: Callable[..., Column], arity: int | tuple[int, int], returns: Type) -> None:
        """As ``add``, with a result of any type."""
        self.add(name, build, arity, returns)

    def add_typed(self, name: str, build: Callable[..., Column], args: Sequence[Type], returns: Type) -> None:
        """Arguments of declared types."""
        self._put(Entry(name, build, (len(args), len(args)), returns, tuple(args)))

    def add_pandas(self, name: str, function: Callable, arity: int, returns: str = "double") -> None:
        """Last resort: a vectorised Python function over pandas series."""
        kind = BOOL if returns == "boolean" else NUMBER
        self.add(name, F.pandas_udf(function, returns), arity, kind)

    def macro(self, name: str, expand: Callable, params: Sequence[str] = ()) -> None:
        """``expand(call, compiler)`` gets the call's syntax and returns a Value or a node to compile."""
        self._put(Entry(name, macro=expand, params=tuple(params)))

    def timeseries(self, name: str, expand: Callable, params: Sequence[str] = ()) -> None:
        """A macro that looks at other rows; told apart for the reader only."""
        self.macro(name, expand, params)

    def overlay(self, name: str, expand: Callable) -> None:
        """A macro in front of what is registered already; it returns None to pass a call on."""
        self._put(replace(self.entries.get(name, Entry(name)), overlay=expand))

    def struct_function(self, name: str, build: Callable[..., Column], fields: Sequence[str], args: int, returns: Type = NUMBER) -> None:
        self._put(Entry(name, struct=StructFunction(build, tuple(fields), args, returns)))

    def producer(self, name: str, build: Callable, fields: Sequence[str] | dict[str, Type], arity: int | tuple[int, int], params: Sequence[str] = (), series: bool = False) -> None:
        """A scalar of the same name stays callable as ``name(x)``; ``name(x).field`` is this."""
        typed = tuple(fields.items()) if isinstance(fields, dict) else tuple((f, NUMBER) for f in fields)
        if not 0 < len(typed) <= MAX_FIELDS:
            raise ValueError(f"{name}: between 1 and {MAX_FIELDS} fields")
        bounds = (arity, arity) if isinstance(arity, int) else arity
        old = self.entries.get(name)
        kept = old if old and old.scalar else Entry(name)
        self._put(replace(kept, producer=Producer(build, typed, bounds, series), params=tuple(params) or kept.params))

    def set_param_names(self, name: str, params: Sequence[str]) -> None:
        entry = self.get(name)
        most = entry.producer.arity[1] if entry.producer and not entry.scalar else entry.arity[1]
        if len(params) < most:
            raise WrongArity(f"{name}: {most} parameter names are needed")
        self._put(replace(entry, params=tuple(params)))

    def define(self, source: str) -> None:
        """``name(p, q) => body``."""
        found = HEADER.fullmatch(source)
        if not found:
            raise ExpressionSyntaxError("Expected 'name(params) => body'", 0, 1, 1)
        name, listed, body = found.groups()
        params = tuple(p.strip() for p in listed.split(",")) if listed.strip() else ()
        if any(not NAME.fullmatch(p) for p in params):
            raise ExpressionSyntaxError("Invalid parameter name", 0, 1, 1)
        if len(set(params)) < len(params):
            raise ExpressionSyntaxError("Duplicate parameter name", 0, 1, 1)
        if len(params) > MAX_PARAMS:
            raise ExpressionSyntaxError("Too many parameters", 0, 1, 1)
        if not body.strip():
            raise ExpressionSyntaxError("Empty function body", 0, 1, 1)
        self._put(Entry(name, arity=(len(params), len(params)), params=params, defined=Defined(params, parser.parse(body))))

    def struct_fields(self, name: str, _seen: frozenset[str] = frozenset()) -> dict[str, list[str]]:
        """Fields that a defined function uses of each parameter, through the functions that it calls."""
        entry = self.entries.get(name)
        if entry is None or entry.defined is None or name in _seen:
            return {}
        used: dict[str, list[str]] = {}
        for node in entry.defined.body.walk():
            if isinstance(node, t.Field) and node.object in entry.params:
                used.setdefault(node.object, []).append(node.name)
            elif isinstance(node, t.Call):
                inner = self.struct_fields(node.name, _seen | {name})
                target = self.entries.get(node.name)
                for param, arg in zip(target.params if target else (), node.args, strict=False):
                    if isinstance(arg, t.Identifier) and arg.name in entry.params and param in inner:
                        used.setdefault(arg.name, []).extend(inner[param])
        out = {p: list(dict.fromkeys(f)) for p, f in used.items()}
        if any(len(f) > MAX_STRUCT_PARAM_FIELDS for f in out.values()):
            raise ExpressionSyntaxError("Too many fields of one parameter")
        return out

    def get(self, name: str) -> Entry:
        try:
            return self.entries[name]
        except KeyError:
            raise UnknownFunction(f"Unknown function '{name}'") from None

    def lookup(self, name: str) -> tuple[int, int] | None:
        """Fewest and most arguments, or None for an unknown name."""
        entry = self.entries.get(name)
        if entry is None:
            return None
        if entry.struct:
            return entry.struct.args, entry.struct.args
        if entry.producer and not entry.scalar:
            return entry.producer.arity
        return entry.arity

    def call(self, name: str, *args: Column | float | bool) -> Column:
        """A direct call of a scalar function on columns or constants."""
        entry = self.get(name)
        if entry.scalar is None:
            raise UnknownFunction(f"'{name}' is not a scalar function")
        if not entry.arity[0] <= len(args) <= entry.arity[1]:
            raise WrongArity(f"Wrong number of arguments for '{name}'")
        return entry.scalar(*[a if isinstance(a, Column) else F.lit(a) for a in args])

    def copy(self) -> Registry:
        return Registry(dict(self.entries), self.version)


def bound(entry: Entry, call: t.Call) -> t.Call:
    """The call with named arguments in the order of the parameters; they must fill a prefix."""
    if not call.has_names:
        return call
    if not entry.params:
        raise ExpressionSyntaxError(f"Function '{call.name}' does not support named arguments")
    slots: dict[int, t.Node] = {}
    named = False
    for i, (name, arg) in enumerate(zip(call.names, call.args, strict=True)):
        if name is None:
            if named:
                raise ExpressionSyntaxError("Positional arguments must precede named arguments")
            place = i
        else:
            named = True
            if name not in entry.params:
                raise ExpressionSyntaxError(f"Unknown named argument '{name}'")
            place = entry.params.index(name)
        if place in slots:
            raise ExpressionSyntaxError("Duplicate named argument")
        slots[place] = arg
    if sorted(slots) != list(range(len(slots))):
        raise ExpressionSyntaxError("Missing argument before a named one")
    return t.Call(call.name, tuple(slots[i] for i in range(len(slots))), (None,) * len(slots))


__all__ = ["Entry", "Producer", "Registry", "Struct", "bound"]
