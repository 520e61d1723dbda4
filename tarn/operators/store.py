"""The version store: content ids, chains of versions, incremental ingest.

Records are (snapshot_index, path, sid, ...); everything is a DataFrame over the whole log, so a snapshot's report or a
chain is a query, and ingesting is appending.

Defined cases: a null content is the empty program's; repeated records of a snapshot count as unchanged; a path without a
record in a snapshot keeps its chain; null paths are a path of their own; an empty log gives empty reports.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _without_docstrings(tree: ast.AST) -> ast.AST:
    for node in ast.walk(tree):
        if isinstance(node, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and ast.get_docstring(node, clean=False) is not None:
            node.body = node.body[1:] or [ast.Pass()]
    return tree


def normalised(code: str | None) -> tuple[str, str]:
    """What a program is known by, and how: its syntax tree without docstrings, else its text without comments."""
    source = (code or "").replace("\r\n", "\n").replace("\r", "\n")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.dump(_without_docstrings(ast.parse(source))), "ast"
    except (SyntaxError, ValueError, RecursionError):
        kept = (re.sub(r"\s+", " ", line.partition("#")[0]).strip() for line in source.split("\n"))
        return "\n".join(x for x in kept if x), "text"


def _frame(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([normalised(c) for c in codes], columns=["normalised", "method"])


def with_content_id(snippets: DataFrame, code: str = "code") -> DataFrame:
    """snippets with method and sid. Ids of trees hold within one Python version only."""
    rows = snippets.withColumn("_n", F.pandas_udf(_frame, "struct<normalised:string,method:string>")(F.col(code)))
    return rows.withColumn("method", F.col("_n.method")).withColumn("sid", F.sha2(F.concat("_n.method", F.lit("\0"), "_n.normalised"), 256)).drop("_n")


def ingest_report(records: DataFrame) -> DataFrame:
    """Per snapshot: records, new (contents first seen there) and unchanged (all others, repeats inside it included)."""
    first = records.groupBy("sid").agg(F.min("snapshot_index").alias("snapshot_index"))
    new = first.groupBy("snapshot_index").agg(F.count("*").alias("n_new"))
    seen = records.groupBy("snapshot_index").agg(F.count("*").alias("n_records"))
    return seen.join(new, "snapshot_index", "left").select("snapshot_index", "n_records", F.coalesce("n_new", F.lit(0)).alias("n_new"), (F.col("n_records") - F.coalesce("n_new", F.lit(0))).alias("n_unchanged"))


def chains(records: DataFrame) -> DataFrame:
    """Entries of each path's chain: records whose content isn't that of the path's record before, numbered v1, v2, ..."""
    line = Window.partitionBy("path").orderBy("snapshot_index")
    changed = records.withColumn("_before", F.lag("sid").over(line)).where(F.col("_before").isNull() | (F.col("_before") != F.col("sid"))).drop("_before")
    return changed.withColumn("version", F.concat(F.lit("v"), F.row_number().over(line)))


def history(entries: DataFrame, path: str) -> DataFrame:
    return entries.where(F.col("path") == path).orderBy("snapshot_index")


def latest(entries: DataFrame) -> DataFrame:
    """(path, sid) of the newest entry; deleted paths keep theirs."""
    return entries.groupBy("path").agg(F.max_by("sid", "snapshot_index").alias("sid"))


def paths_of(entries: DataFrame) -> DataFrame:
    return entries.select("sid", "path").distinct()


def stats(records: DataFrame, entries: DataFrame, embedded: DataFrame) -> DataFrame:
    return (
        records.agg(F.count_distinct("snapshot_index").alias("snapshots"), F.count_distinct("sid").alias("snippets"))
        .crossJoin(entries.agg(F.count_distinct("path").alias("paths"), F.count("*").alias("versions")))
        .crossJoin(embedded.agg(F.count_distinct("sid").alias("embedded")))
    )


def missing_embeddings(snippets: DataFrame, embedded: DataFrame) -> DataFrame:
    return snippets.select("sid").distinct().join(embedded.select("sid"), "sid", "left_anti")


def rebuild_cost(report: DataFrame, cost: Column | float) -> DataFrame:
    """Cost of embedding everything at each snapshot against new contents only; the speed-up is infinite if none is new."""
    c = F.lit(cost) if isinstance(cost, (int, float)) else cost
    sums = report.agg(F.sum(F.col("n_records") * c).alias("full_cost"), F.sum(F.col("n_new") * c).alias("incremental_cost"))
    return sums.withColumn("speed_up", F.when(F.col("incremental_cost") > 0, F.round(F.col("full_cost") / F.col("incremental_cost"), 5)).otherwise(F.lit(float("inf"))))


def is_code_path(path: Column) -> Column:
    """Python files that aren't hidden or in a hidden folder."""
    return path.endswith(".py") & ~F.contains(F.concat(F.lit("/"), path), F.lit("/."))


def carried_forward(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Full listings of each commit from changes (snapshot_index, path, status, code): what isn't changed is carried on,
    what is deleted (status D) is gone until it is added again.

    Each change holds from its commit to the one before the path's next change; commits in between are added by range."""
    line = Window.partitionBy("path").orderBy("snapshot_index")
    last = commits.agg(F.max("snapshot_index").alias("_end"))
    held = changes.withColumn("_next", F.lead("snapshot_index").over(line)).crossJoin(F.broadcast(last))
    until = F.coalesce(F.col("_next") - 1, F.col("_end"))
    return held.where("status <> 'D'").select(F.explode(F.sequence(F.col("snapshot_index"), until)).alias("snapshot_index"), "path", "code")


def embed_missing(snippets: DataFrame, embedded: DataFrame, encode) -> DataFrame:  # noqa: ANN001
    """embedded with the vectors of contents it lacks; encode takes an iterator of lists of codes and gives vectors."""
    todo = snippets.join(missing_embeddings(snippets, embedded), "sid", "left_semi").dropDuplicates(["sid"]).select("sid", "code")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"sid": f["sid"], "vec": list(encode(f["code"].tolist()))})

    return embedded.select("sid", "vec").unionByName(todo.mapInPandas(run, "sid string, vec array<float>"))
