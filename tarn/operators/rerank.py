"""Margins, gates, rarity confidence and blending over ranked lists.

A ranked list has query_id, doc_id, score and rank; verdicts are passed in as columns or rows (passed of total), never
worked out here.

Defined cases: a query with one candidate has a null margin and is certain; without examples confidence is 0; equal scores
keep the order of ranks; a query without candidates has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DIGITS = 5


def _by_query() -> WindowSpec:
    return Window.partitionBy("query_id")


def margins(ranked: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(query_id, margin): first minus second score; null, which is no margin to be uncertain about, with one score."""
    top = ranked.where("rank <= 2").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    return top.select("query_id", F.round(F.col("a") - F.col("b"), digits).alias("margin"))


def rarity_confidence(passed: Column, total: Column, m: Column) -> Column:
    """Share of examples passed, the less the more candidates pass: 0 to 1."""
    raw = passed / total / (1.0 + F.log2(F.greatest(m.cast("double"), F.lit(1.0))))
    return F.when((passed > 0) & (total > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(0.0)


def with_confidence(verified: DataFrame) -> DataFrame:
    """Rows (query_id, doc_id, passed, total) with m, the candidates of the query that pass anything, n_all_pass and conf."""
    m = F.sum(F.when(F.col("passed") > 0, 1).otherwise(0)).over(_by_query())
    every = F.sum(F.when((F.col("total") > 0) & (F.col("passed") == F.col("total")), 1).otherwise(0)).over(_by_query())
    return verified.withColumns({"m": m, "n_all_pass": every}).withColumn("conf", rarity_confidence(F.col("passed"), F.col("total"), F.col("m")))


def restricted(verified: DataFrame, candidates: DataFrame) -> DataFrame:
    """Verdicts of a subset of the candidates, with m and conf of the subset."""
    kept = verified.drop("m", "n_all_pass", "conf").join(candidates.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    return with_confidence(kept)


def min_max(ranked: DataFrame) -> DataFrame:
    """ranked with norm, the score between the least and largest of the query's pool; 1 where they don't differ."""
    low, high = F.min("score").over(_by_query()), F.max("score").over(_by_query())
    return ranked.withColumn("norm", F.when(high - low < 1e-9, 1.0).otherwise((F.col("score") - low) / (high - low)))


def gated(ranked: DataFrame, margin: DataFrame, tau: float, base: int, extend: int, fits: DataFrame | None = None) -> DataFrame:
    """The candidates to verify: the first `base`, and for uncertain queries those down to `extend` that fit.

    fits: (query_id, doc_id, fits); pairs it lacks fit."""
    rows = ranked.join(margin, "query_id", "left")
    uncertain = F.coalesce(F.col("margin") < tau, F.lit(False))
    rows = rows.withColumn("uncertain", uncertain)
    ok = F.lit(True)
    if fits is not None:
        rows, ok = rows.join(fits, ["query_id", "doc_id"], "left"), F.coalesce("fits", F.lit(True))
    return rows.where((F.col("rank") <= base) | (F.col("uncertain") & (F.col("rank") <= extend) & ok)).drop("fits")


def router_counters(candidates: DataFrame, queries: DataFrame, base: int) -> DataFrame:
    """How many queries there are, how many are extended, and by how many candidates."""
    c = candidates.agg(F.count_distinct(F.when(F.col("uncertain"), F.col("query_id"))).alias("extended"), F.count(F.when(F.col("rank") > base, 1)).alias("extra"))
    return queries.agg(F.count_distinct("query_id").alias("queries")).crossJoin(c)


def blend(ranked: DataFrame, verified: DataFrame, alpha: float | Column, depth: int | None = None, digits: int = DIGITS) -> DataFrame:
    """ranked (its whole pool) with conf, final = norm + alpha * conf and final_rank; ties keep their order.

    depth: confidence counts for the first ranks only."""
    conf = F.coalesce("conf", F.lit(0.0))
    if depth is not None:
        conf = F.when(F.col("rank") <= depth, conf).otherwise(0.0)
    rows = min_max(ranked).join(verified.select("query_id", "doc_id", "conf"), ["query_id", "doc_id"], "left").withColumn("conf", conf)
    rows = rows.withColumn("final", F.round(F.col("norm") + F.col("conf") * alpha, digits))
    return rows.withColumn("final_rank", F.row_number().over(_by_query().orderBy(F.desc("final"), "rank")))


def unseen(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """Candidates without a cached verdict."""
    return candidates.join(cache.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")


def status_counts(verified: DataFrame) -> DataFrame:
    return verified.groupBy("first_status").agg(F.count("*").alias("n"))
