"""Factor expressions: function calls on operands, planned together and evaluated on a panel."""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.operators.panel import OPERATORS, Panel


class ExpressionError(ValueError):
    """An operator or operand that is not known, or syntax beyond calls, names and numbers."""


class Planner:
    """A graph of all expressions of a panel, in which equal calls are one node.

    A node is a call's value as a column of the panel; what is called twice, in one expression or in two, is computed
    once.  The panel puts the nodes in order by what they are partitioned by (see :class:`Panel`).
    """

    def __init__(self, panel: DataFrame, operators: Mapping[str, Callable] | None = None):
        self.panel = Panel(panel)
        self.known = {**(operators or {}), **OPERATORS}
        self.operands = set(panel.columns)
        self.nodes: dict[tuple, Column] = {}

    def value(self, expression: str) -> Column:
        """The column of an expression."""
        got, _ = self._value(ast.parse(expression, mode="eval").body)
        return got if isinstance(got, Column) else F.lit(float(got))

    def _value(self, node: ast.expr) -> tuple[Column | float, tuple]:
        """A node's value and what it is known by: equal keys are equal values."""
        match node:
            case ast.Constant(value=int() | float() as number) if not isinstance(number, bool):
                return number, ("number", type(number).__name__, number)
            case ast.UnaryOp(op=ast.USub() | ast.UAdd() as sign, operand=inner):
                x, key = self._value(inner)
                return (x, key) if isinstance(sign, ast.UAdd) else (-x, ("minus", key))
            case ast.Name(id=name) if name in self.operands:
                return F.col(name), ("operand", name)
            case ast.Name(id=name):
                raise ExpressionError(f"unknown operand {name}")
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in self.known:
                values, keys = zip(*map(self._value, args), strict=True) if args else ((), ())
                key = (name, *keys)
                if key not in self.nodes:
                    self.nodes[key] = self.panel.call(self.known[name], *values)
                return self.nodes[key], key
            case ast.Call(func=ast.Name(id=name)):
                raise ExpressionError(f"unknown operator {name}")
        raise ExpressionError(f"not allowed here: {ast.unparse(node)}")


def evaluate_wide(panel: DataFrame, expressions: Mapping[str, str], operators: Mapping[str, Callable] | None = None) -> DataFrame:
    """``panel`` with the value of each expression as a column of its name.

    All are planned together: one exchange for all rolling operators, one for all cross-sections of what these gave,
    and so on as deep as the expressions nest one kind in the other.  ``operators`` adds operators of the caller; a
    built-in name always wins.
    """
    planner = Planner(panel, operators)
    values = {name: planner.value(e) for name, e in expressions.items()}
    return planner.panel.df.select(*[F.col(c) for c in panel.columns if c not in values], *[v.alias(n) for n, v in values.items()])


def evaluate(panel: DataFrame, expression: str, out: str = "value", operators: Mapping[str, Callable] | None = None) -> DataFrame:
    """``panel`` with the expression's value as column ``out``."""
    return evaluate_wide(panel, {out: expression}, operators)


def evaluate_many(panel: DataFrame, expressions: Mapping[str, str], keys: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """Long table (factor_name, date, ticker, value) of many expressions, planned together."""
    df = evaluate_wide(panel, {f"f_{n}": e for n, e in expressions.items()})
    names = list(expressions)
    long = df.select(*keys, *[F.col(f"f_{n}").alias(n) for n in names]).unpivot(list(keys), names, "factor_name", "value")
    return long.select("factor_name", *keys, "value")


def evaluate_apart(panel: DataFrame, expressions: Mapping[str, str], keys: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """What :func:`evaluate_many` gives, where only expressions with cross-sections go through the exchange by date.

    That carries a date's ranked values and not the finished values of all others; for a panel that is cheap to read twice or
    whose own exchange both sides share.
    """

    def stays(expression: str) -> bool:
        planner = Planner(panel)
        planner.value(expression)
        return planner.panel.in_histories(panel)

    near = {n: e for n, e in expressions.items() if stays(e)}
    sides = [evaluate_many(panel, side, keys) for side in (near, {n: e for n, e in expressions.items() if n not in near}) if side]
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
