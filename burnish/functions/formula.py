"""Arithmetic and boolean formulas over columns, written in Python syntax."""

from __future__ import annotations

import ast
import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from burnish.functions.columns import c

_BINARY = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a.cast("double"), b.cast("double"))),
    ast.Mod: lambda a, b: F.when(b != 0, F.pmod(a, F.when(b != 0, b))),
    ast.Pow: F.pow,
    ast.BitAnd: operator.and_,
    ast.BitOr: operator.or_,
}
_COMPARE = {
    ast.Eq: operator.eq,
    ast.NotEq: operator.ne,
    ast.Lt: operator.lt,
    ast.LtE: operator.le,
    ast.Gt: operator.gt,
    ast.GtE: operator.ge,
}
_UNARY = {ast.USub: operator.neg, ast.UAdd: lambda a: a, ast.Not: operator.invert, ast.Invert: operator.invert}


def names_in(formula: str) -> frozenset[str]:
    """The columns a formula reads."""
    return frozenset(n.id for n in ast.walk(_parse(formula)) if isinstance(n, ast.Name))


def column_of(formula: str) -> Column:
    """The formula as a Column. A division by zero is NULL. Anything but arithmetic and logic raises."""
    return _column(_parse(formula).body)


def _parse(formula: str) -> ast.Expression:
    try:
        return ast.parse(formula.strip(), mode="eval")
    except SyntaxError as error:
        raise ValueError(f"not a formula: {formula!r}") from error


def _column(node: ast.AST) -> Column:
    match node:
        case ast.Name(id=name):
            return c(name)
        case ast.Constant(value=bool() | int() | float() | str() as value):
            return F.lit(value)
        case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
            return _BINARY[type(op)](_column(left), _column(right))
        case ast.UnaryOp(op=op, operand=operand) if type(op) in _UNARY:
            return _UNARY[type(op)](_column(operand))
        case ast.BoolOp(op=op, values=values):
            join = operator.and_ if isinstance(op, ast.And) else operator.or_
            return reduce(join, [_column(v) for v in values])
        case ast.Compare(left=left, ops=ops, comparators=rights) if all(type(o) in _COMPARE for o in ops):
            sides = [_column(left), *(_column(r) for r in rights)]
            return reduce(operator.and_, [_COMPARE[type(o)](a, b) for o, a, b in zip(ops, sides, sides[1:])])
    raise ValueError(f"not allowed in a formula: {ast.unparse(node)}")
