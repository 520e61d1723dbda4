"""Benchmarks of verification: faulty and cosmetic versions of programs, outcomes of runs on gold programs, and rates.

Defined cases: a program that can't be parsed has no faulty version; a statement without examples counts as such, not as
a failure; empty tables give no rows."""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators import sandbox
from tarn.operators.programs import _compiles, runnable

#: What an operator of a syntax tree is exchanged for.
_EXCHANGED = {
    ast.Lt: ast.GtE, ast.LtE: ast.Lt, ast.Gt: ast.LtE, ast.GtE: ast.Gt, ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.In: ast.NotIn,
    ast.Add: ast.Sub, ast.Sub: ast.Add, ast.Mult: ast.Add, ast.FloorDiv: ast.Mult, ast.Mod: ast.FloorDiv, ast.And: ast.Or, ast.Or: ast.And,
}


def _faults(tree: ast.AST) -> list[Callable[[], None]]:
    """Every small change there is: an operator exchanged, a number one larger, a condition negated, a bound or an element
    of a call left out."""
    found: list[Callable[[], None]] = []
    for node in ast.walk(tree):
        for field in ("op", "ops"):
            of = getattr(node, field, None)
            for i, op in enumerate(of if isinstance(of, list) else [of] if of else []):
                if (new := _EXCHANGED.get(type(op))) is not None:
                    found.append(partial(of.__setitem__, i, new()) if isinstance(of, list) else partial(setattr, node, field, new()))
        if isinstance(node, ast.Constant) and type(node.value) is int:
            found.append(partial(setattr, node, "value", node.value + 1))
        if isinstance(node, (ast.If, ast.While)):
            found.append(partial(setattr, node, "test", ast.UnaryOp(ast.Not(), node.test)))
        if isinstance(node, ast.Call) and len(node.args) > 1:
            found.append(partial(node.args.pop, 0))
    return found


def faulty(code: str, seed: int) -> str | None:
    """The program with one change to its syntax tree that still compiles; None if there is none. The seed picks it."""
    source = runnable(code)[0]
    if source is None:
        return None
    before = ast.unparse(ast.parse(source))
    n = len(_faults(ast.parse(source)))
    for k in range(n):
        tree = ast.parse(source)
        _faults(tree)[(seed + k) % n]()
        changed = ast.unparse(ast.fix_missing_locations(tree))
        if changed != before and runnable(changed)[0] is not None:
            return changed
    return None


def cosmetic(code: str, seed: int) -> str:
    """The program printed anew from its syntax tree, with a remark and blank lines between statements, which changes
    nothing; one without a tree only gets the remark."""
    remark = f"# printed anew, {seed}\n"
    try:
        statements = [ast.unparse(n) for n in ast.parse(code).body]
    except (SyntaxError, ValueError, RecursionError):
        return remark + code
    return remark + "".join(s + "\n" * (1 + (seed + i) % 3) for i, s in enumerate(statements))


def outcome(passed: Column, total: Column, failure: Column) -> Column:
    """PASS, or what the first run that didn't match came to."""
    kind = F.when(failure == "timeout_skipped", "timeout").when(failure.isin("timeout", "syntax_error", "error", "empty_output"), failure).otherwise("wrong_output")
    return F.when((total > 0) & (passed == total), "PASS").otherwise(kind)


def gold_run(verdicts: DataFrame, statements: DataFrame) -> DataFrame:
    """Outcomes of gold programs by layout of their statement; statements without examples are counted as such."""
    rows = statements.join(verdicts.select("query_id", "passed", "total", "failure"), "query_id", "left")
    some = F.size("examples") > 0
    return rows.groupBy(F.when(some, F.col("source_format")).otherwise("none").alias("source_format"), F.when(some, outcome(F.col("passed"), F.col("total"), F.col("failure"))).otherwise("no_examples").alias("kind")).agg(F.count("*").alias("n"))


def plainly_passes(code: str, examples: list[tuple[str, str]], seconds: float = sandbox.SECONDS) -> bool:
    """The naive harness: as a script only, without repair of old syntax, outputs equal but for white space around them."""
    return _compiles(code) is None and all(
        r.status == "ok" and r.mode == "script" and r.stdout.strip() == expected.strip() for stdin, expected in examples for r in [sandbox.run(code, stdin, seconds=seconds)])


def with_naive(pairs: DataFrame) -> DataFrame:
    """Pairs (query_id, doc_id, code, examples) with naive, whether the naive harness passes them: what the other one gains."""

    def judge(codes: pd.Series, examples: pd.Series) -> pd.Series:
        return pd.Series([bool(len(e)) and plainly_passes(c or "", [(x["stdin"], x["expected"]) for x in e]) for c, e in zip(codes, examples, strict=True)], dtype=bool)

    return pairs.withColumn("naive", F.pandas_udf(judge, "boolean")("code", F.coalesce("examples", F.array().cast("array<struct<stdin:string,expected:string,idx:int>>"))))


def failures(verdicts: DataFrame) -> DataFrame:
    """Programs (passed, total, failure) that fail, counted by what the first run that didn't match came to."""
    kind = outcome(F.col("passed"), F.col("total"), F.col("failure"))
    return verdicts.where("total > 0").groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).where("kind <> 'PASS'")


def version_rates(ranked: DataFrame) -> DataFrame:
    """Of ranked versions (query_id, idx, rank, digest, passed, total, blended, role: good, cosmetic or faulty): how often a
    cosmetic change keeps the fingerprint, a fault changes it, and a working version comes first, overall and where the
    fault passes the examples; by rank, by similarity only, and by age only."""
    good = F.col("role") != "faulty"
    each = ranked.groupBy("query_id").agg(
        F.max(F.when(F.col("role") == "good", F.col("digest"))).alias("g"), F.max(F.when(F.col("role") == "cosmetic", F.col("digest"))).alias("c"),
        F.max(F.when(F.col("role") == "faulty", F.col("digest"))).alias("f"), F.max(F.when(F.col("role") == "faulty", F.col("passed") == F.col("total"))).alias("both"),
        F.min_by(good, "rank").alias("first"), F.max_by(good, F.struct("blended", "idx")).alias("by_similarity"), F.max_by(good, "idx").alias("by_age"))
    share = lambda c: F.round(F.avg(c.cast("double")), 5)
    both = lambda c: F.round(F.avg(F.when(F.col("both"), c.cast("double"))), 5)
    return each.agg(
        F.count("*").alias("n"), share(F.col("g") == F.col("c")).alias("certified_unchanged"), share(F.col("g") != F.col("f")).alias("fault_differs"),
        share(F.col("first")).alias("working_first"), both(F.col("first")).alias("working_first_both_pass"), share(F.col("by_similarity")).alias("similarity_only"), share(F.col("by_age")).alias("newest_first"))
