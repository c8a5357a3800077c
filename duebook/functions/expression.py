"""Arithmetic over named results, as Spark columns: names, numbers, + - * /, unary minus, parentheses."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

from duebook.functions.columns import rounded
from duebook.functions.predicates import SpecError

_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide}


def names(text: str) -> set[str]:
    """The names an expression uses."""
    try:
        return {n.id for n in ast.walk(ast.parse(text, mode="eval")) if isinstance(n, ast.Name)}
    except SyntaxError:
        raise SpecError(f"cannot read expression {text!r}") from None


def arithmetic(text: str, known) -> Column:
    """The value as a double rounded to two places; 0 where it is undefined, such as after a division by 0."""

    def build(node) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in known:
                raise SpecError(f"unknown name {node.id!r} in {text!r}")
            return F.col(f"`{node.id}`").cast("double")
        raise SpecError(f"not allowed in an expression: {ast.unparse(node)!r}")

    names(text)
    return F.coalesce(rounded(F.nanvl(build(ast.parse(text, mode="eval").body), F.lit(None).cast("double"))), F.lit(0.0))
