"""Expressions over waves from text: parsed, checked node by node, and built as columns. Nothing is evaluated as Python."""

from __future__ import annotations

import ast
import operator
from collections.abc import Mapping
from typing import Any

from ..frame import Wave

BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow,
    ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.BitXor: operator.xor, ast.LShift: operator.lshift, ast.RShift: operator.rshift,
}
COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


def evaluate(text: str, waves: Mapping[str, Wave]) -> Any:
    """The wave (or number) of an expression in which ``waves`` are the names."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
        return _node(tree.body, waves)
    except SyntaxError as error:
        raise ValueError(f"{text!r}: {error.msg}") from error
    except (TypeError, NotImplementedError) as error:
        raise ValueError(f"{text!r}: {error}") from error


def _node(node: ast.expr, waves: Mapping[str, Wave]) -> Any:
    if isinstance(node, ast.Name):
        if node.id not in waves:
            raise ValueError(f"unknown name {node.id!r}")
        return waves[node.id]
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return node.value
    if isinstance(node, ast.BinOp) and type(node.op) in BINARY:
        return BINARY[type(node.op)](_node(node.left, waves), _node(node.right, waves))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Invert, ast.USub)):
        value = _node(node.operand, waves)
        return ~value if isinstance(node.op, ast.Invert) else (0 - value)
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in COMPARE:
        return COMPARE[type(node.ops[0])](_node(node.left, waves), _node(node.comparators[0], waves))
    if isinstance(node, ast.Subscript):
        return _node(node.value, waves)[_bits(node.slice)]
    raise ValueError(f"{ast.unparse(node)!r} isn't allowed in an expression")


def _bits(node: ast.expr) -> int | slice:
    number = lambda n: n.value if isinstance(n, ast.Constant) and isinstance(n.value, int) else None
    if isinstance(node, ast.Slice) and node.step is None and number(node.lower) is not None and number(node.upper) is not None:
        return slice(number(node.lower), number(node.upper))
    if number(node) is not None:
        return number(node)
    raise ValueError("a bit range has constant bounds")
