"""Conversion formulas compiled to Column expressions; nothing is ever evaluated as Python code."""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def _divide(a: Column, b: Column) -> Column:
    """As IEEE division: a zero divisor gives an infinity, or null for 0 / 0."""
    zero = F.when(a > 0, F.lit(_INF)).when(a < 0, F.lit(-_INF))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def _log(f):
    return lambda c: F.when(c == 0, F.lit(-_INF)).when(c > 0, f(c))


_CALLS = {"log": _log(F.log), "log10": _log(F.log10), "exp": F.exp}


def parse(formula: str) -> ast.expr:
    """The formula's tree. ValueError unless it uses x and nothing but x, mw, e, numbers, + - * / **, log, log10, exp."""
    try:
        tree = ast.parse(formula.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"no formula: {formula}") from e
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    found = set()
    for n in ast.walk(tree):
        match n:
            case ast.BinOp(op=ast.Add() | ast.Sub() | ast.Mult() | ast.Div() | ast.Pow()):
                continue
            case ast.UnaryOp(op=ast.USub() | ast.UAdd()):
                continue
            case ast.Call(func=ast.Name(id=f), args=[_], keywords=[]) if f in _CALLS:
                continue
            case ast.Name(id=v) if id(n) in called or v in ("x", "mw", "e"):
                found.add(v)
            case ast.Constant(value=v) if type(v) in (int, float):
                continue
            case ast.operator() | ast.unaryop() | ast.expr_context():
                continue
            case _:
                raise ValueError(f"not allowed in a formula: {formula}")
    if "x" not in found:
        raise ValueError(f"a formula must use x: {formula}")
    return tree


def uses_weight(formula: str) -> bool:
    return any(isinstance(n, ast.Name) and n.id == "mw" for n in ast.walk(parse(formula)))


def compile_formula(formula: str, x: Column, mw: Column | None = None) -> Column:
    """The formula over columns of doubles."""

    def build(n: ast.expr) -> Column:
        match n:
            case ast.BinOp(left=a, op=op, right=b):
                left, right = build(a), build(b)
                match op:
                    case ast.Add():
                        return left + right
                    case ast.Sub():
                        return left - right
                    case ast.Mult():
                        return left * right
                    case ast.Div():
                        if isinstance(b, ast.Constant) and b.value:
                            return left / right
                        return _divide(left, right)
                    case _:
                        return F.pow(left, right)
            case ast.UnaryOp(op=op, operand=a):
                return -build(a) if isinstance(op, ast.USub) else build(a)
            case ast.Call(func=ast.Name(id=f), args=[a]):
                return _CALLS[f](build(a))
            case ast.Name(id="x"):
                return x
            case ast.Name(id="e"):
                return F.lit(math.e)
            case ast.Name():
                if mw is None:
                    raise ValueError(f"the formula needs molecular weights: {formula}")
                return mw
            case ast.Constant(value=v):
                return F.lit(float(v))
            case _:
                raise ValueError(formula)

    return build(parse(formula))
