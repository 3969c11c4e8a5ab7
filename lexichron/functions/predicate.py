"""Predicates written as text, such as ``==1951`` or ``.between(1950, 1959)``, as Columns.

The grammar is closed: a comparison operator with one literal, ``.between(a, b)``,
``.isin([..])``, ``.isnull()``, ``.notnull()``.  Anything else raises ValueError;
nothing is evaluated as code but literals.
"""

from __future__ import annotations

import ast
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"==": operator.eq, "!=": operator.ne, "<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt}


def _literal(text: str):
    try:
        return ast.literal_eval(text.strip())
    except (ValueError, SyntaxError) as error:
        raise ValueError(f"no literal: {text!r}") from error


def _scalar(text: str):
    value = _literal(text)
    if not isinstance(value, (int, float, str, bool)):
        raise ValueError(f"no single value: {text!r}")
    return value


def predicate(column: str, text: str) -> Column:
    """The filter on ``column`` that ``text`` states."""
    text, subject = text.strip(), F.col(column)
    if m := re.fullmatch(r"(==|!=|<=|>=|<|>)(.+)", text, re.S):
        return _COMPARE[m[1]](subject, F.lit(_scalar(m[2])))
    if m := re.fullmatch(r"\.between\((.+)\)", text, re.S):
        ends = _literal(f"({m[1]},)")
        if len(ends) != 2:
            raise ValueError(f"between takes two values: {text!r}")
        return subject.between(*map(F.lit, ends))
    if m := re.fullmatch(r"\.isin\((.+)\)", text, re.S):
        values = _literal(m[1])
        if not isinstance(values, (list, tuple, set)):
            raise ValueError(f"isin takes a list: {text!r}")
        return subject.isin(*values)
    if text == ".isnull()":
        return subject.isNull()
    if text == ".notnull()":
        return subject.isNotNull()
    raise ValueError(f"no predicate: {text!r}")
