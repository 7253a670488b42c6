"""Row predicates written as ``"price > 10 and kind in ['a', 'b']"``.

Python's own ``ast`` reads the text; each node becomes one built-in Column, so the filter still
reaches the scan. Missing values fail every comparison except ``!=`` and ``not in``.
"""

from __future__ import annotations

import ast
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col, is_float, require

_COMPARE = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt,
    ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
}


def _over_zero(x: Column) -> Column:
    """IEEE: a number over zero is an infinity with the number's sign, zero and NaN over zero are NaN."""
    return F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).when(x < 0, float("-inf"))


def _divide(a: Column, b: Column) -> Column:
    x, y = a.cast("double"), b.cast("double")
    return F.when(y == 0, _over_zero(x)).otherwise(F.try_divide(x, y))


def _floor_divide(a: Column, b: Column) -> Column:
    x, y = a.cast("double"), b.cast("double")
    return F.when(y == 0, _over_zero(x)).otherwise(F.rint(F.try_divide(x - _modulo(a, b), y)))


def _modulo(a: Column, b: Column) -> Column:
    """The remainder with the sign of the divisor; NaN for a zero divisor."""
    x, y = a.cast("double"), b.cast("double")
    rest = F.try_mod(x, y)
    moved = F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest)
    return F.when(y == 0, F.when(x.isNotNull(), float("nan"))).otherwise(moved)


_ARITHMETIC = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul,
    ast.Div: _divide, ast.FloorDiv: _floor_divide, ast.Mod: _modulo, ast.Pow: F.pow,
}
#: Operators whose result may be NaN though no operand is missing.
_MAY_BE_NAN = (ast.Div, ast.FloorDiv, ast.Mod, ast.Pow)
#: A quoted string, a back-quoted name, or one of the symbols that stand for and / or / not.
_TOKENS = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|`([^`]+)`|([&|~])""")
_WORDS = {"&": " and ", "|": " or ", "~": " not "}


def _python_text(text: str) -> tuple[str, dict[str, str]]:
    """Spell symbols as words and give back-quoted names a plain spelling."""
    names: dict[str, str] = {}

    def swap(m: re.Match) -> str:
        if m.group(1):
            return m.group(1)
        if m.group(3):
            return _WORDS[m.group(3)]
        alias = f"__quoted_{len(names)}"
        names[alias] = m.group(2)
        return alias

    return _TOKENS.sub(swap, text).strip(), names


def predicate(df: DataFrame, text: str) -> Column:
    """The boolean Column for a predicate text over ``df``'s columns."""
    source, aliases = _python_text(text)
    kinds = {f.name: f.dataType for f in df.schema}

    def value(node: ast.expr) -> Column:
        match node:
            case ast.Name(id=name):
                return col(require(df, [aliases.get(name, name)])[0])
            case ast.Constant(value=v):
                return F.lit(v)
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                return -value(inner)
            case ast.UnaryOp(op=ast.UAdd(), operand=inner):
                return value(inner)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _ARITHMETIC:
                return _ARITHMETIC[type(op)](value(a), value(b))
        raise ValueError(f"not a value: {ast.unparse(node)}")

    def present(*nodes: ast.expr) -> Column:
        """True when no column in these operands is missing (NULL or NaN)."""
        ok = F.lit(True)
        for n in {x.id for node in nodes for x in ast.walk(node) if isinstance(x, ast.Name)}:
            name = aliases.get(n, n)
            ok = ok & col(name).isNotNull()
            if is_float(kinds.get(name)):
                ok = ok & ~F.isnan(col(name))
        for node in nodes:
            if any(isinstance(x, ast.BinOp) and isinstance(x.op, _MAY_BE_NAN) for x in ast.walk(node)):
                ok = ok & ~F.isnan(value(node))
        return ok

    def compare(a: ast.expr, op: ast.cmpop, b: ast.expr) -> Column:
        if isinstance(b, (ast.List, ast.Tuple)):
            inside = value(a).isin([value(e) for e in b.elts]) & present(a)
            if isinstance(op, (ast.In, ast.Eq)):
                return inside
            if isinstance(op, (ast.NotIn, ast.NotEq)):
                return ~value(a).isin([value(e) for e in b.elts]) | ~present(a)
            raise ValueError("a list goes with in, not in, == or !=")
        if type(op) not in _COMPARE:
            raise ValueError("in and not in need a list")
        plain = _COMPARE[type(op)](value(a), value(b))
        return (plain | ~present(a, b)) if isinstance(op, ast.NotEq) else (plain & present(a, b))

    def condition(node: ast.expr, negated: bool = False) -> Column:
        match node:
            case ast.BoolOp(op=op, values=parts):
                conds = [condition(p, negated) for p in parts]
                join = operator.and_ if isinstance(op, ast.And) else operator.or_
                out = conds[0]
                for c in conds[1:]:
                    out = join(out, c)
                return out
            case ast.UnaryOp(op=ast.Not(), operand=inner):
                return ~condition(inner, True)
            case ast.Compare(left=first, ops=ops, comparators=rest):
                out, left = None, first
                for op, right in zip(ops, rest):
                    c = compare(left, op, right)
                    out = c if out is None else out & c
                    left = right
                # Under "not" a NULL must count as false; elsewhere a filter drops it anyway,
                # and the bare form is the one that is pushed to the scan.
                return F.coalesce(out, F.lit(False)) if negated else out
            case ast.Name() | ast.Constant():
                return F.coalesce(value(node).cast("boolean"), F.lit(False))
        raise ValueError(f"not a condition: {ast.unparse(node)}")

    return condition(ast.parse(source, mode="eval").body)


def query(df: DataFrame, text: str) -> DataFrame:
    """Rows for which the predicate holds."""
    return df.where(predicate(df, text))
