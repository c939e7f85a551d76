"""formulary: a typed expression language compiled to native Spark columns."""

from formulary.errors import ExpressionError
from formulary.functions.registry import Registry
from formulary.operators.series import ordered
from formulary.plans.dag import ExpressionSet
from formulary.plans.parser import parse
from formulary.plans.types import BOOL, NUMBER, Struct
from formulary.session import Engine, standard

__version__ = "0.1.0"
__all__ = ["BOOL", "NUMBER", "Engine", "ExpressionError", "ExpressionSet", "Registry", "Struct", "ordered", "parse", "standard"]
