"""From expressions to native Spark columns.

Types are checked against the schema before anything runs. Functions of the
language are inlined, lookback is pushed down to the columns read, so that all
offsets over one order share one window, and comparisons guard against Spark's
order of NaN only where a NaN can come.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formulary.errors import ExpressionSyntaxError, TypeMismatch, UnknownIdentifier, WrongArity
from formulary.functions import library
from formulary.functions.registry import Entry, Registry, bound
from formulary.plans import tree as t
from formulary.plans.types import BOOL, NUMBER, TEXT, UNKNOWN, Array, Struct, Type, Value, may_be_nan, of_spark

ARITHMETIC, ORDER, EQUALITY, LOGIC = ("+", "-", "*", "/", "%", "^"), ("<", "<=", ">", ">="), ("==", "!="), ("and", "or")


def leaf_lag(window: WindowSpec | None) -> Callable[[Column, str, int], Column]:
    """Reads an earlier row's column by the order of a window."""

    def read(column: Column, name: str, back: int) -> Column:
        if window is None:
            raise ExpressionSyntaxError("Lookback needs an ordered series")
        return F.lag(column, back).over(window)

    return read


def checked(valid: Column, value: Column, kind: T.DataType, message: str) -> Column:
    """The value, or an error where something is not as it must be."""
    return F.when(valid, value).otherwise(F.raise_error(F.lit(message)).cast(kind))


#: No number of a column of this type is further from 0.
BOUNDS = {T.ByteType: 2.0**7, T.ShortType: 2.0**15, T.IntegerType: 2.0**31, T.LongType: 2.0**63, T.DecimalType: 1e38}


@dataclass(frozen=True)
class Compiler:
    schema: T.StructType
    registry: Registry
    params: Mapping[str, object] = field(default_factory=dict)
    window: WindowSpec | None = None
    #: Column, its name and an offset to a column; None reads by the window.
    earlier: Callable[[Column, str, int], Column] | None = None
    #: "error" keeps Spark's error for a zero divisor, "null" gives NULL.
    on_zero: str = "error"
    #: Compiled values of the parameters of the functions that are being inlined.
    scope: Mapping[str, Value] = field(default_factory=dict)
    #: Rows that everything is read before the current one.
    back: int = 0
    inlining: tuple[str, ...] = ()
    #: Compiled producers, and the arguments of functions being inlined.
    memo: dict = field(default_factory=dict)
    #: Whether a lookback beyond the first row is an error, not NULL.
    strict: bool = False
    #: Rows that a lookback whose offset is no constant may go back.
    most_back: int = 64
    #: Rows besides ``back`` that everything is read before the current one, where that depends on the row.
    far: Column | None = None

    # Entry points

    def value(self, node: t.Node) -> Value:
        out = self.compile(node)
        if out.type is TEXT:
            raise TypeMismatch("A text is no value")
        if isinstance(out.type, Array):
            raise TypeMismatch("A role is no value; aggregate it")
        return out

    def number(self, node: t.Node) -> Value:
        out = self.compile(node)
        if out.type is not NUMBER:
            raise TypeMismatch("Expression did not evaluate to a number")
        return out

    def predicate(self, node: t.Node) -> Value:
        out = self.compile(node)
        if out.type is not BOOL:
            raise TypeMismatch("Expression did not evaluate to bool")
        return out

    def shifted(self, back: int) -> Compiler:
        """The same, for rows further back."""
        return replace(self, back=self.back + back) if back else self

    def constant_number(self, node: t.Node) -> float:
        """The number of an expression that does not depend on a row."""
        out = self.number(node)
        if out.constant is None:
            raise ExpressionSyntaxError("A constant number is needed here")
        return float(out.constant)

    # Nodes

    def compile(self, node: t.Node) -> Value:
        match node:
            case t.Number(x):
                return Value(F.lit(x), NUMBER, not math.isfinite(x), False, x, bound=abs(x) if math.isfinite(x) else math.inf)
            case t.Bool(x):
                return Value(F.lit(x), BOOL, False, False, x)
            case t.Text(x):
                return Value(F.lit(x), TEXT, False)
            case t.Identifier(name):
                return self.identifier(name)
            case t.Param(name):
                return self.param(name)
            case t.Field(owner, name):
                return self.field_of(owner, name)
            case t.Chain(path):
                return self.chain(path)
            case t.Producer():
                return self.produced(node)
            case t.Call():
                return self.call(node)
            case t.Unary():
                return self.unary(node)
            case t.Binary():
                return self.binary(node)
            case t.Lookback(target, index):
                return self.lookback(target, index)
            case t.Ternary(condition, yes, no):
                return self.either(self.predicate(condition), self.compile(yes), self.compile(no))
        raise TypeError(node)

    def leaf(self, column: Column, name: str) -> Column:
        kind = self.schema[name].dataType
        if self.far is not None:
            return self.distant(column, kind)
        if not self.back:
            return column
        lagged = (self.earlier or leaf_lag(self.window))(column, name, self.back)
        if self.strict and self.window is not None:
            return checked(F.row_number().over(self.window) > self.back, lagged, kind, "lookback beyond the first row")
        return lagged

    def distant(self, column: Column, kind: T.DataType) -> Column:
        """The column as many rows earlier as the current row says; only the last ``most_back`` rows are held."""
        if self.window is None:
            raise ExpressionSyntaxError("An offset that depends on the row needs a window")
        held = F.collect_list(F.struct(column.alias("v"))).over(self.window.rowsBetween(-self.most_back, 0))
        whole = checked((self.far >= 0) & (F.abs(self.far - F.rint(self.far)) <= 1e-9), F.rint(self.far), T.DoubleType(), "a lookback must be a whole number of rows, not negative")
        place = F.size(held) - 1 - self.back - whole
        full = F.size(held) > self.most_back  # there may be rows before those that are held
        out = F.when(place >= 0, F.get(held, place.cast("int"))["v"]).when((place < 0) & full, F.raise_error(F.lit(f"a lookback of more than {self.most_back} rows")).cast(kind))
        if self.strict:
            out = out.when(place < 0, F.raise_error(F.lit("lookback beyond the first row")).cast(kind))
        return F.when(self.far.isNotNull(), out)

    def typed(self, column: Column, data: T.DataType) -> Value:
        kind = of_spark(data)
        if kind is UNKNOWN:
            raise TypeMismatch(f"A column of type {data.simpleString()} is no value")
        if kind is NUMBER:
            return Value(column.cast("double") if not isinstance(data, T.DoubleType) else column, NUMBER, may_be_nan(data), bound=BOUNDS.get(type(data), math.inf))
        return Value(column, kind)

    def column(self, name: str) -> Value | None:
        if name in self.schema.names:
            return self.typed(self.leaf(F.col(f"`{name}`"), name), self.schema[name].dataType)
        return None

    def identifier(self, name: str) -> Value:
        if name in self.scope:
            return self.scope[name]
        if (found := self.column(name)) is None:
            raise UnknownIdentifier(f"Unknown identifier '{name}'")
        return found

    def param(self, name: str) -> Value:
        if f"${name}" in self.scope:
            return self.scope[f"${name}"]
        if name not in self.params:
            raise UnknownIdentifier(f"Unknown parameter '${name}'")
        value = self.params[name]
        if isinstance(value, (list, tuple)):
            if len(value) == 1:
                return self.compile(t.Number(float(value[0])))
            return Value(F.array(*[F.lit(float(x)) for x in value]) if value else F.array().cast("array<double>"), Array(NUMBER))
        if isinstance(value, Column):  # a role held by a column of the row
            return Value(value.cast("array<double>"), Array(NUMBER))
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise TypeMismatch(f"Parameter '${name}' is no number")
        return self.compile(t.Number(float(value)))

    def get(self, owner: Value, name: str) -> Value:
        if not isinstance(owner.type, Struct):
            raise TypeMismatch(f"'{name}' is asked of what is no struct")
        kind = owner.type.get(name)
        if kind is None:
            raise UnknownIdentifier(f"Unknown field '{name}'")
        if owner.parts:
            return dict(owner.parts)[name]
        column = owner.column.getField(name)
        return Value(column.cast("double"), NUMBER) if kind is NUMBER else Value(column, kind)

    def field_of(self, owner: str, name: str) -> Value:
        """Struct field first, then a column of the dotted name, then a producer without arguments."""
        held = self.scope.get(owner) or self.column_or_none(owner)
        if held is not None and isinstance(held.type, Struct) and held.type.get(name) is not None:
            return self.get(held, name)
        if (flat := self.column(f"{owner}.{name}")) is not None:
            return flat
        entry = self.registry.entries.get(owner)
        if entry and entry.producer and entry.producer.arity[0] == 0:
            return self.produced(t.Producer(owner, (), (), name))
        if held is not None and not isinstance(held.type, Struct):
            raise TypeMismatch(f"'{owner}' is no struct")
        raise UnknownIdentifier(f"Unknown field access '{owner}.{name}'")

    def column_or_none(self, name: str) -> Value | None:
        try:
            return self.column(name)
        except TypeMismatch:
            return None

    def chain(self, path: tuple[str, ...]) -> Value:
        out = self.identifier(path[0])
        for name in path[1:]:
            out = self.get(out, name)
        return out

    def unary(self, node: t.Unary) -> Value:
        if node.op == "not":
            inner = self.predicate(node.operand)
            return Value(~inner.column, BOOL, False, inner.raises, None if inner.constant is None else not inner.constant)
        inner = self.number(node.operand)
        return Value(-inner.column, NUMBER, inner.nan, inner.raises, None if inner.constant is None else -inner.constant, bound=inner.bound)

    def binary(self, node: t.Binary) -> Value:
        op = node.op
        if op in LOGIC:
            return self.logic(op, self.predicate(node.left), self.predicate(node.right))
        left, right = self.compile(node.left), self.compile(node.right)
        if op in EQUALITY:
            if left.type is not right.type or left.type not in (NUMBER, BOOL):
                raise TypeMismatch(f"'{op}' needs two numbers or two truth values")
            return self.equality(op, left, right)
        if left.type is not NUMBER or right.type is not NUMBER:
            raise TypeMismatch(f"'{op}' needs two numbers")
        return self.order(op, left, right) if op in ORDER else self.arithmetic(op, left, right)

    def arithmetic(self, op: str, a: Value, b: Value) -> Value:
        raises = a.raises or b.raises
        constant = None
        if a.constant is not None and b.constant is not None and op in "+-*":
            constant = {"+": a.constant + b.constant, "-": a.constant - b.constant, "*": a.constant * b.constant}[op]
        if op in "/%":
            zero = b.constant is None or b.constant == 0
            if self.on_zero == "null" and zero:
                divided = a.column / F.nullif(b.column, F.lit(0.0)) if op == "/" else a.column % F.nullif(b.column, F.lit(0.0))
                return Value(divided, NUMBER, True, raises)
            if not zero and a.constant is not None:
                constant = a.constant / b.constant if op == "/" else math.fmod(a.constant, b.constant)
            return Value(a.column / b.column if op == "/" else a.column % b.column, NUMBER, True, raises or zero, constant)
        if op == "^":
            return Value(library.power(a.column, b.column), NUMBER, True, raises)
        column = {"+": a.column + b.column, "-": a.column - b.column, "*": a.column * b.column}[op]
        # Infinities make NaN; whatever may be infinite is marked as if it were NaN already.
        most = a.bound * b.bound if op == "*" else a.bound + b.bound
        finite = most < 1e300
        return Value(column, NUMBER, a.nan or b.nan or not finite, raises, constant, bound=most if finite else math.inf)

    @staticmethod
    def order(op: str, a: Value, b: Value) -> Value:
        """Spark takes NaN for the largest; only the side that it would make true needs a guard."""
        column = {"<": a.column < b.column, "<=": a.column <= b.column, ">": a.column > b.column, ">=": a.column >= b.column}[op]
        guard = b if op in ("<", "<=") else a
        if guard.nan:
            column = column & ~F.isnan(guard.column)
        return Value(column, BOOL, False, a.raises or b.raises)

    @staticmethod
    def equality(op: str, a: Value, b: Value) -> Value:
        guard = a if a.type is NUMBER and a.nan and b.nan else None
        if op == "==":
            column = a.column == b.column
            column = column & ~F.isnan(guard.column) if guard else column
        else:
            column = a.column != b.column
            column = column | F.isnan(guard.column) if guard else column
        return Value(column, BOOL, False, a.raises or b.raises)

    @staticmethod
    def logic(op: str, a: Value, b: Value) -> Value:
        if b.raises:  # the order of conjuncts is Catalyst's to choose, that of branches is not
            if op == "and":
                column = F.when(a.column, b.column).when(~a.column, F.lit(False)).otherwise(F.when(~b.column, F.lit(False)))
            else:
                column = F.when(a.column, F.lit(True)).when(~a.column, b.column).otherwise(F.when(b.column, F.lit(True)))
        else:
            column = a.column & b.column if op == "and" else a.column | b.column
        return Value(column, BOOL, False, a.raises or b.raises)

    @staticmethod
    def either(condition: Value, yes: Value, no: Value) -> Value:
        if yes.type is not no.type and yes.type != no.type:
            raise TypeMismatch("Branches are of different types")
        # NULL decides for neither branch.
        column = F.when(condition.column, yes.column).when(~condition.column, no.column)
        return Value(column, yes.type, yes.nan or no.nan, condition.raises or yes.raises or no.raises)

    def choice(self, call: t.Call) -> Value:
        """if(c, a, b): the condition may be a number, true unless 0."""
        if len(call.args) != 3:
            raise WrongArity("Wrong number of arguments for 'if'")
        condition = self.compile(call.args[0])
        if condition.type is NUMBER:
            condition = Value(condition.column != 0, BOOL, False, condition.raises)  # NaN counts as true
        elif condition.type is not BOOL:
            raise TypeMismatch("The condition of 'if' is neither bool nor number")
        return self.either(condition, self.compile(call.args[1]), self.compile(call.args[2]))

    def offset(self, index: t.Node) -> int:
        n = self.constant_number(index)
        if not math.isfinite(n) or n < 0 or abs(n - round(n)) > 1e-9:
            raise ExpressionSyntaxError("A lookback must be a whole number of rows, not negative")
        return round(n)

    def lookback(self, target: t.Node, index: t.Node) -> Value:
        if self.window is None and self.earlier is None:
            raise ExpressionSyntaxError("Lookback needs an ordered series")
        # What functions' parameters are bound to was compiled without this offset.
        inner = replace(self, scope={k: v for k, v in self.scope.items() if k.startswith("$")})
        node = substitute(target, self.scope_nodes())
        back = self.number(index)
        if back.constant is not None:
            return inner.shifted(self.offset(index)).compile(node)
        if self.earlier is not None:
            raise ExpressionSyntaxError("On streams a lookback is a constant number of rows")
        far = back.column if self.far is None else self.far + back.column
        found = replace(inner, far=far, memo={}).compile(node)
        return replace(found, raises=True, constant=None)

    def scope_nodes(self) -> dict[str, t.Node]:
        """What the parameters of the function being inlined stand for, in terms of columns."""
        return self.memo.get(("scope", self.inlining), {})

    # Calls

    def call(self, call: t.Call) -> Value:
        entry = self.registry.get(call.name)
        if entry.overlay and (out := entry.overlay(call, self)) is not None:
            return self.expanded(out)
        if entry.macro:
            return self.expanded(entry.macro(bound(entry, call), self))
        call = bound(entry, call)
        if entry.defined:
            return self.inlined(entry, call)
        if entry.producer and not entry.scalar:
            return self.struct_of(entry, call)
        if entry.struct:
            return self.spread(entry, call)
        if entry.scalar is None:
            return self.expanded(None)
        self.count_args(call, *entry.arity)
        args = [self.compile(a) for a in call.args]
        wanted = entry.arg_types or (NUMBER,) * len(args)
        for arg, kind in zip(args, wanted, strict=True):
            if arg.type is not kind and not (isinstance(kind, Struct) and isinstance(arg.type, Struct)):
                raise TypeMismatch(f"Argument of '{call.name}' is {arg.type!r}, not {kind!r}")
        nan = entry.makes_nan or any(a.nan for a in args)
        return Value(entry.scalar(*[a.column for a in args]), entry.returns, nan, any(a.raises for a in args))

    def expanded(self, out: Value | t.Node | None) -> Value:
        if out is None:
            raise WrongArity("No function takes this call")
        return out if isinstance(out, Value) else self.compile(out)

    @staticmethod
    def count_args(call: t.Call, fewest: int, most: int) -> None:
        if not fewest <= len(call.args) <= most:
            raise WrongArity(f"Wrong number of arguments for '{call.name}'")

    def inlined(self, entry: Entry, call: t.Call) -> Value:
        """The body with its parameters bound to the compiled arguments."""
        if entry.name in self.inlining:
            raise ExpressionSyntaxError(f"Function '{entry.name}' calls itself")
        self.count_args(call, len(entry.params), len(entry.params))
        fields = self.registry.struct_fields(entry.name)
        scope: dict[str, Value] = {}
        for name, arg in zip(entry.params, call.args, strict=True):
            value = self.compile(arg)
            if name in fields and not isinstance(value.type, Struct):
                raise TypeMismatch(f"Parameter '{name}' of '{entry.name}' is a struct")
            scope[name] = value
        outer = self.scope_nodes()
        nodes = {name: substitute(arg, outer) for name, arg in zip(entry.params, call.args, strict=True)}
        inner = replace(self, scope={k: v for k, v in self.scope.items() if k.startswith("$")} | scope, inlining=(*self.inlining, entry.name), memo={**self.memo})
        inner.memo[("scope", inner.inlining)] = nodes
        return inner.compile(entry.defined.body)

    def spread(self, entry: Entry, call: t.Call) -> Value:
        function = entry.struct
        self.count_args(call, function.args, function.args)
        columns: list[Column] = []
        for arg in call.args:
            if not isinstance(arg, t.Identifier):
                raise ExpressionSyntaxError(f"Arguments of '{call.name}' are names of structs")
            for name in function.fields:
                part = self.field_of(arg.name, name)
                if part.type is not NUMBER:
                    raise TypeMismatch(f"'{arg.name}.{name}' is no number")
                columns.append(part.column)
        return Value(function.build(*columns), function.returns)

    def struct_of(self, entry: Entry, call: t.Call) -> Value:
        """One struct for each producer, arguments and offset, however often it is asked for."""
        made = entry.producer
        self.count_args(call, *made.arity)
        key = (self.registry.version, t.render(call), self.back, tuple(self.inlining))
        if key not in self.memo:
            if made.series:
                columns = made.build(call.args, self)
            else:
                columns = made.build(*[self.number(a).column for a in call.args])
            missing = {n for n, _ in made.fields} ^ set(columns)
            if missing:
                raise UnknownIdentifier(f"Producer '{entry.name}' has other fields than declared: {sorted(missing)}")
            parts = tuple((n, Value(columns[n], kind)) for n, kind in made.fields)
            self.memo[key] = Value(F.struct(*[columns[n].alias(n) for n, _ in made.fields]), Struct(made.fields), parts=parts)
        return self.memo[key]

    def produced(self, node: t.Producer) -> Value:
        entry = self.registry.get(node.name)
        if entry.overlay and any(isinstance(a, t.Text) for a in node.args) and (out := entry.overlay(node.call, self)) is not None:
            return self.get(self.expanded(out), node.field)
        if entry.producer is None:
            whole = self.call(node.call)  # of a function that returns a struct
            return self.get(whole, node.field)
        return self.get(self.struct_of(entry, bound(entry, node.call)), node.field)


def substitute(node: t.Node, names: Mapping[str, t.Node]) -> t.Node:
    """The node with names replaced; a field of a replaced name is asked of what replaces it."""
    if not names:
        return node
    go = lambda n: substitute(n, names)
    match node:
        case t.Identifier(name):
            return names.get(name, node)
        case t.Field(owner, name) if owner in names:
            match names[owner]:
                case t.Identifier(other):
                    return t.Field(other, name)
                case t.Field(a, b):
                    return t.Chain((a, b, name))
                case t.Chain(path):
                    return t.Chain((*path, name))
                case t.Call(f, args, keys):
                    return t.Producer(f, args, keys, name)
            raise TypeMismatch(f"'{owner}' is no struct")
        case t.Call(name, args, keys):
            return t.Call(name, tuple(map(go, args)), keys)
        case t.Producer(name, args, keys, of):
            return t.Producer(name, tuple(map(go, args)), keys, of)
        case t.Unary(op, operand):
            return t.Unary(op, go(operand))
        case t.Binary(op, left, right):
            return t.Binary(op, go(left), go(right))
        case t.Lookback(target, index):
            return t.Lookback(go(target), go(index))
        case t.Ternary(condition, yes, no):
            return t.Ternary(go(condition), go(yes), go(no))
    return node
