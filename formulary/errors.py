"""Errors of parsing, checking and evaluating expressions."""

from __future__ import annotations


class ExpressionError(Exception):
    """Carries a message and, where the text is at fault, a position (from 0), line and column (from 1)."""

    code = "ERROR"

    def __init__(self, message: str, position: int | None = None, line: int | None = None, column: int | None = None):
        super().__init__(message if line is None else f"{message} at line {line}, column {column}")
        self.message, self.position, self.line, self.column = message, position, line, column


class ExpressionSyntaxError(ExpressionError):
    code = "SYNTAX"


class UnknownIdentifier(ExpressionError):
    code = "UNKNOWN_IDENTIFIER"


class UnknownFunction(ExpressionError):
    code = "UNKNOWN_FUNCTION"


class WrongArity(ExpressionError):
    code = "WRONG_ARITY"


class DivisionByZero(ExpressionError):
    code = "DIVISION_BY_ZERO"


class CircularDependency(ExpressionError):
    code = "CIRCULAR_DEPENDENCY"


class TypeMismatch(ExpressionError):
    code = "TYPE_MISMATCH"


def runtime_error(error: Exception) -> Exception:
    """Spark's division errors as DivisionByZero; any other error as it is."""
    text = str(error)
    if "REMAINDER_BY_ZERO" in text:
        return DivisionByZero("Modulo by zero")
    if "DIVIDE_BY_ZERO" in text:
        return DivisionByZero("Division by zero")
    return error
