"""Static types of expressions and their meaning in Spark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T


class Type:
    name = "unknown"

    def __repr__(self) -> str:
        return self.name


class _Number(Type):
    name = "number"


class _Bool(Type):
    name = "bool"


class _Text(Type):
    name = "text"


UNKNOWN, NUMBER, BOOL, TEXT = Type(), _Number(), _Bool(), _Text()


@dataclass(frozen=True)
class Struct(Type):
    fields: tuple[tuple[str, Type], ...]
    name = "struct"

    def get(self, name: str) -> Type | None:
        return dict(self.fields).get(name)

    def __repr__(self) -> str:
        return f"struct<{', '.join(f'{k}: {v!r}' for k, v in self.fields)}>"


@dataclass(frozen=True)
class Array(Type):
    """Values bound to a role; not a value of the language."""

    item: Type
    name = "array"


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def of_spark(data: T.DataType) -> Type:
    """The type that a column has in the language; UNKNOWN for what it cannot hold."""
    if isinstance(data, NUMERIC):
        return NUMBER
    if isinstance(data, T.BooleanType):
        return BOOL
    if isinstance(data, T.StructType):
        return Struct(tuple((f.name, of_spark(f.dataType)) for f in data.fields))
    if isinstance(data, T.ArrayType):
        return Array(of_spark(data.elementType))
    return UNKNOWN


def may_be_nan(data: T.DataType) -> bool:
    return isinstance(data, (T.FloatType, T.DoubleType))


@dataclass(frozen=True)
class Value:
    """A compiled expression: a column, its type, and what is known of it."""

    column: Column
    type: Type
    nan: bool = True
    raises: bool = False
    #: The number or truth value, where the expression is constant.
    constant: float | bool | None = None
    #: Compiled fields of a struct that was built in place.
    parts: tuple[tuple[str, Value], ...] = ()
    #: No number of the expression is further from 0, NaN aside.
    bound: float = float("inf")
