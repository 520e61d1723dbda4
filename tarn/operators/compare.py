"""Whether a program's output counts as the expected one.

Defined cases: a null output is the empty one; texts over the bound of literals are compared by tokens; numbers that
aren't finite equal nothing but their own spelling; orders are ignored only where asked.
"""

from __future__ import annotations

import ast
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE, LITERAL_CHARS = 1e-6, 20_000
# Words that count as equal whatever their case.
VERDICTS = ("yes", "no", "true", "false", "possible", "impossible")
_WORDS = {"true": True, "false": False, "null": None}
_NONE = object()


def _literal(text: str) -> object:
    """The value of a text that looks like a list, tuple, dict, string or JSON word."""
    if not text or len(text) > LITERAL_CHARS or not (text[0] in "[({\"'" or text.lower() in _WORDS):
        return _NONE
    try:
        return ast.literal_eval(re.sub(r"\b(?:true|false|null)\b", lambda m: str(_WORDS[m[0]]), text))
    except Exception:  # noqa: BLE001  whatever literal_eval makes of arbitrary text, it isn't a literal then
        return _NONE


def _same(a: object, b: object, tol: float) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a == b
    match a, b:
        case (int() | float()), (int() | float()):
            return abs(a - b) <= tol * max(1.0, abs(b))
        case (list() | tuple()), (list() | tuple()):
            return len(a) == len(b) and all(map(lambda x, y: _same(x, y, tol), a, b))
        case dict(), dict():
            return a.keys() == b.keys() and all(_same(v, b[k], tol) for k, v in a.items())
    return a == b


def _number(token: str) -> float | None:
    try:
        return float(token)
    except ValueError:
        return None


def _tokens_match(a: str, b: str, tol: float) -> bool:
    if a == b or a.lower() == b.lower() and a.lower() in VERDICTS:
        return True
    x, y = _number(a), _number(b)
    return x is not None and y is not None and math.isfinite(x) and math.isfinite(y) and abs(x - y) <= tol * max(1.0, abs(y))


def compare(actual: str | None, expected: str | None, any_order: bool = False, tol: float = TOLERANCE) -> tuple[bool, str, int, int]:
    """Matched, the first reason that decides, and both numbers of tokens."""
    a, b = (actual or "").strip(), (expected or "").strip()
    s, t = a.split(), b.split()
    if a == b:
        reason = "exact_match"
    elif (x := _literal(a)) is not _NONE and (y := _literal(b)) is not _NONE and _same(x, y, tol):
        reason = "literal_match"
    elif not a or not b:
        return False, "empty_mismatch", len(s), len(t)
    elif len(s) == len(t) and all(_tokens_match(x, y, tol) for x, y in zip(s, t, strict=True)):
        reason = "token_match"
    else:
        lines = [sorted(line.strip() for line in z.splitlines() if line.strip()) for z in (a, b)]
        if any_order and len(lines[0]) > 1 and lines[0] == lines[1]:
            reason = "line_set_match"
        elif any_order and len(s) > 1 and sorted(s) == sorted(t):
            reason = "token_multiset_match"
        else:
            return False, "token_mismatch", len(s), len(t)
    return True, reason, len(s), len(t)


def _frame(actual: pd.Series, expected: pd.Series, any_order: pd.Series) -> pd.DataFrame:
    rows = [compare(a, e, bool(o)) for a, e, o in zip(actual, expected, any_order, strict=True)]
    return pd.DataFrame(rows, columns=["matched", "reason", "tokens_actual", "tokens_expected"])


def comparison(actual: Column, expected: Column, any_order: Column) -> Column:
    """All steps of the comparison, as a struct."""
    return F.pandas_udf(_frame, "struct<matched:boolean,reason:string,tokens_actual:int,tokens_expected:int>")(actual, expected, any_order)


# --- the steps that need no parsing of literals, as columns ---------------------------------------------------------


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def tokens_match(actual: Column, expected: Column, tol: float = TOLERANCE) -> Column:
    """Token by token: equal, verdict words of any case, or numbers within the tolerance."""

    def one(a: Column, b: Column) -> Column:
        x, y = a.try_cast("double"), b.try_cast("double")
        finite = ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) != float("inf")) & (F.abs(y) != float("inf"))
        close = F.coalesce(finite & (F.abs(x - y) <= tol * F.greatest(F.lit(1.0), F.abs(y))), F.lit(False))
        return (a == b) | ((F.lower(a) == F.lower(b)) & F.lower(a).isin(*VERDICTS)) | close

    s, t = tokens(actual), tokens(expected)
    return (F.size(s) == F.size(t)) & F.forall(F.arrays_zip(s.alias("a"), t.alias("b")), lambda z: F.when(z["a"].isNull() | z["b"].isNull(), False).otherwise(one(z["a"], z["b"])))


def lines_match_any_order(actual: Column, expected: Column) -> Column:
    lines = lambda c: F.array_sort(F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""))
    return (F.size(lines(actual)) > 1) & (lines(actual) == lines(expected))


def tokens_match_any_order(actual: Column, expected: Column) -> Column:
    return (F.size(tokens(actual)) > 1) & (F.array_sort(tokens(actual)) == F.array_sort(tokens(expected)))
