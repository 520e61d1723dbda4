"""The layout of example inputs, program shapes, and whether they fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(stdin: Column) -> Column:
    lines = F.split(F.regexp_replace(F.coalesce(stdin, F.lit("")), "\r", ""), "\n")
    return F.filter(lines, lambda x: x.rlike(r"\S"))


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda t: t != "")


def example_shape(stdin: Column) -> Column:
    """Lines, tokens of the first line, its number if that is all, and the layouts n-then-n and multi-case."""
    lines = _lines(stdin)
    first = _tokens(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
    number = F.when((F.size(first) == 1) & F.get(first, F.lit(0)).rlike(r"^[-+]?\d{1,18}$"), F.get(first, F.lit(0)).cast("bigint"))
    rest = F.size(lines) - 1
    n_then_n = F.coalesce((number > 0) & (rest == number), F.lit(False))
    # the modulus isn't evaluated for a count of zero
    divides = F.when(number >= 1, rest % number == 0).otherwise(False)
    multi = F.coalesce((number >= 1) & (number < rest) & divides & ~n_then_n, F.lit(False))
    numeric = F.forall(F.flatten(F.transform(lines, _tokens)), lambda t: t.rlike(r"^[-+]?\d+(\.\d+)?$"))
    some = F.size(lines) > 0
    return F.struct(
        F.size(lines).alias("n_lines"), F.when(some, F.size(first)).otherwise(0).alias("first_line_tokens"), number.alias("first_token_int"),
        (some & numeric).alias("all_numeric"), n_then_n.alias("n_then_n_lines"), multi.alias("multi_case_t"),
    )


def program_shape(solution_class: Column, solve_func: Column, calls: Column, case_loop: Column, n_loop: Column, splits: Column) -> Column:
    """The first layout that a program's traits point to."""
    return (
        F.when(solution_class | (solve_func & (calls == 0)), "functional").when(case_loop, "multi-case-t").when(n_loop, "n-then-n-lines")
        .when(splits | (calls > 1), "token-line").when(calls == 1, "single-line").otherwise("unknown")
    )


def compatible(io_shape: Column, valid: Column, n_lines: Column, first_int: Column, n_then_n: Column, multi: Column) -> Column:
    """Whether a program of this shape can read an input of this layout."""
    return F.coalesce(
        F.when(~valid | io_shape.isin("unknown", "functional"), False).when(io_shape == "single-line", n_lines == 1)
        .when(io_shape == "multi-case-t", multi | (first_int.isNotNull() & (n_lines > 1)))
        .when(io_shape == "n-then-n-lines", n_then_n | (n_lines > 1)).otherwise(True), F.lit(False))
