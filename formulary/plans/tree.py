"""Nodes of an expression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


class Node:
    """Immutable; equal when all parts are equal."""

    def children(self) -> tuple[Node, ...]:
        return ()

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children():
            yield from child.walk()


@dataclass(frozen=True)
class Number(Node):
    value: float


@dataclass(frozen=True)
class Bool(Node):
    value: bool


@dataclass(frozen=True)
class Text(Node):
    value: str


@dataclass(frozen=True)
class Identifier(Node):
    name: str


@dataclass(frozen=True)
class Param(Node):
    name: str


@dataclass(frozen=True)
class Field(Node):
    object: str
    name: str


@dataclass(frozen=True)
class Chain(Node):
    path: tuple[str, ...]


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...] = ()
    #: A name or None for each argument.
    names: tuple[str | None, ...] = ()

    def children(self) -> tuple[Node, ...]:
        return self.args

    @property
    def has_names(self) -> bool:
        return any(self.names)


@dataclass(frozen=True)
class Producer(Node):
    """One field of what a struct-producing function returns."""

    name: str
    args: tuple[Node, ...]
    names: tuple[str | None, ...]
    field: str

    def children(self) -> tuple[Node, ...]:
        return self.args

    @property
    def call(self) -> Call:
        return Call(self.name, self.args, self.names)


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node

    def children(self) -> tuple[Node, ...]:
        return self.left, self.right


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node

    def children(self) -> tuple[Node, ...]:
        return (self.operand,)


@dataclass(frozen=True)
class Lookback(Node):
    target: Node
    index: Node

    def children(self) -> tuple[Node, ...]:
        return self.target, self.index


@dataclass(frozen=True)
class Ternary(Node):
    condition: Node
    yes: Node
    no: Node

    def children(self) -> tuple[Node, ...]:
        return self.condition, self.yes, self.no


def render(node: Node) -> str:
    """Text that parses to an equal node."""
    match node:
        case Number(value):
            return "null" if value != value else repr(float(value))
        case Bool(value):
            return "true" if value else "false"
        case Text(value):
            return f'"{value}"'
        case Identifier(name):
            return name
        case Param(name):
            return f"${name}"
        case Field(owner, name):
            return f"{owner}.{name}"
        case Chain(path):
            return ".".join(path)
        case Call(name, args, names):
            return f"{name}({', '.join(f'{k}={render(a)}' if k else render(a) for a, k in zip(args, names, strict=True))})"
        case Producer(field=field):
            return f"{render(node.call)}.{field}"
        case Binary("**" | "^", left, right):
            return f"(({render(left)}) ^ ({render(right)}))"
        case Binary(op, left, right):
            return f"({render(left)} {op} {render(right)})"
        case Unary("not", operand):
            return f"(not {render(operand)})"
        case Unary(op, operand):
            return f"({op}{render(operand)})"
        case Lookback(target, index):
            return f"({render(target)})[{render(index)}]"
        case Ternary(condition, yes, no):
            return f"({render(condition)} ? {render(yes)} : {render(no)})"
    raise TypeError(node)
