"""Retrieval metrics, sweeps, audits and reports.

Defined cases: queries without a relevant document don't count; those without results count as 0; repeated judgments
count once; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10, 20, 100, 1000)


def retrieval(ranked: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = CUTS, by: tuple[str, ...] = ()) -> DataFrame:
    """k, ndcg, mrr, recall and map (binary) over queries with a relevant document; those without results count as 0.

    by: columns of ranked that tell several lists apart (of a sweep); each has its own rows."""
    relevant = qrels.where("relevance > 0").select("query_id", "doc_id").distinct()
    hits = ranked.join(relevant, ["query_id", "doc_id"])
    return of_hits(hits, relevant.groupBy("query_id").agg(F.count("*").alias("n_rel")), cuts, by, ranked.select(*by).distinct() if by else None)


def of_hits(hits: DataFrame, totals: DataFrame, cuts: tuple[int, ...] = CUTS, by: tuple[str, ...] = (), lists: DataFrame | None = None) -> DataFrame:
    """The same from hits (by, query_id, rank), one for each relevant document in a list, and totals (query_id, n_rel).

    A query's metrics depend on its hits' ranks and its number of relevant documents only, so pairs of queries and
    relevant documents are never needed. lists: the lists (by) there are, a row each; a query's may be without hits."""
    keys = [*by, "query_id"]
    inside_cuts = hits.where(F.col("rank") <= max(cuts)).select(*keys, "rank")
    numbered = inside_cuts.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")))
    of = numbered.groupBy(*keys).agg(F.collect_list(F.struct("rank", "i")).alias("h"))  # at most max(cuts) each
    all_ = totals.where("n_rel > 0")
    if by:
        all_ = all_.crossJoin(F.broadcast(lists))  # the settings of a sweep
    rows = all_.join(of, keys, "left").select(*by, "n_rel", "h", F.explode(F.array(*[F.lit(k) for k in cuts])).alias("k"))
    inside = F.filter(F.coalesce("h", F.array().cast("array<struct<rank:int,i:int>>")), lambda x: x["rank"] <= F.col("k"))
    total_of = lambda f: F.aggregate(F.transform("inside", f), F.lit(0.0), lambda a, v: a + v)
    rows = rows.withColumn("inside", F.array_sort(inside))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("k", "n_rel").cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    each = rows.select(
        *by, "k", (total_of(lambda x: 1.0 / F.log2(x["rank"] + 1.0)) / ideal).alias("ndcg"),
        F.coalesce(1.0 / F.array_min(F.transform("inside", lambda x: x["rank"])), F.lit(0.0)).alias("mrr"),
        (F.size("inside") / F.col("n_rel")).alias("recall"), (total_of(lambda x: x["i"] / x["rank"]) / F.least("k", "n_rel")).alias("map"))
    return each.groupBy(*by, "k").agg(*[F.round(F.avg(c), 5).alias(c) for c in ("ndcg", "mrr", "recall", "map")])


def rank_of_gold(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, gold_rank): the first rank of a relevant document, 0 if there is none in the list."""
    relevant = qrels.where("relevance > 0").select("query_id", "doc_id")
    return first_hits(ranked.join(relevant, ["query_id", "doc_id"]), relevant.select("query_id").distinct())


def first_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """The same from hits (query_id, rank)."""
    found = hits.groupBy("query_id").agg(F.min("rank").alias("r"))
    return queries.join(found, "query_id", "left").select("query_id", F.coalesce("r", F.lit(0)).alias("gold_rank"))


def best_setting(scores: DataFrame, value: str, score: str, tie: str | None = None) -> DataFrame:
    """The setting of the best score; ties go to the smallest `tie`, else the smallest value."""
    return scores.orderBy(F.desc(score), F.asc(tie or value), value).limit(1)


def plateau(scores: DataFrame, value: str, score: str, within: float = 0.001) -> DataFrame:
    """The smallest setting whose score is within a distance of the best."""
    top = scores.agg(F.max(score).alias("top"))
    return scores.crossJoin(F.broadcast(top)).where(F.col(score) >= F.col("top") - within).agg(F.min(value).alias(value))


def adopted(scores: DataFrame, value: str, score: str, base: float | Column, tie: str | None = None) -> DataFrame:
    """The best setting of a sweep with its gain over a base score, and whether it is adopted: only if it gains and isn't
    the setting 0, which changes nothing."""
    best = best_setting(scores, value, score, tie)
    gain = F.round(F.col(score) - base, 5)
    return best.withColumn("gain", gain).withColumn("decision", F.when((F.col("gain") > 0) & (F.col(value) > 0), "ADOPT").otherwise("REJECT"))


def outcome_counts(runs: DataFrame) -> DataFrame:
    """Runs (source_format, kind, passed) counted by format and kind."""
    return runs.groupBy("source_format", "kind").agg(F.count("*").alias("n"), F.sum(F.col("passed").cast("int")).alias("passed"))


def projection(shares: DataFrame, high: float = 0.60, low: float = 0.40) -> DataFrame:
    """Shares (source_format, share, rate) summed up, and what that decides."""
    total = shares.agg(F.round(F.sum(F.col("share") * F.col("rate")), 6).alias("projected"))
    return total.withColumn("decision", F.when(F.col("projected") >= high, "PROCEED").when(F.col("projected") >= low, "FIX_FIRST").otherwise("STOP"))


def id_alignment(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """How many pairs of ids are equal, as they are and by their first number."""
    number = lambda c: F.regexp_extract(F.col(c).cast("string"), r"(\d+)", 1)
    return pairs.agg(
        F.count("*").alias("n"), F.count(F.when(F.col(a).cast("string") == F.col(b).cast("string"), 1)).alias("exact"),
        F.count(F.when((number(a) != "") & (number(a) == number(b)), 1)).alias("by_number"))


def deltas(rungs: DataFrame) -> DataFrame:
    """Rungs (rung, base, score) with the difference to their base; those without a score are marked not run."""
    base = rungs.select(F.col("rung").alias("base"), F.col("score").alias("base_score"))
    return rungs.join(base, "base", "left").select("rung", "base", "score", F.round(F.col("score") - F.col("base_score"), 5).alias("delta"), F.when(F.col("score").isNull(), "not run").otherwise("run").alias("state"))


def reproduced(recorded: DataFrame, measured: DataFrame, within: float = 0.002) -> DataFrame:
    """Recorded scores (rung, metric, score) with those measured now, and whether they are as near as that; a rung that
    wasn't measured says so."""
    now = measured.select("rung", "metric", F.col("score").alias("now"))
    rows = recorded.join(now, ["rung", "metric"], "left").withColumn("difference", F.round(F.col("now") - F.col("score"), 5))
    return rows.withColumn("state", F.when(F.col("now").isNull(), "not run").when(F.abs("difference") <= within, "same").otherwise("differs"))


METRICS = ("ndcg_at_10", "mrr_at_10", "map_at_10", "recall_at_10", "main_score")


def result_errors(json: Column) -> Column:
    """What is wrong with a task result, as an array of texts; empty if it is valid."""
    at = lambda path: F.get_json_object(json, path)
    first = "$.scores.test[0]"
    errors = [F.when(at(f"$.{k}").isNull(), f"missing {k}") for k in ("dataset_revision", "task_name", "mteb_version", "evaluation_time", "scores")]
    errors.append(F.when(at(first).isNull(), "missing scores.test"))
    errors += [F.when(at(first).isNotNull() & at(f"{first}.{m}").isNull(), f"missing {m}") for m in METRICS]
    errors += [F.when(at(f"{first}.{m}").cast("double").between(0, 1) == False, f"{m} out of range") for m in METRICS]  # noqa: E712
    errors += [F.when(at(first).isNotNull() & at(f"{first}.{k}").isNull(), f"missing {k}") for k in ("hf_subset", "languages")]
    return F.array_compact(F.array(*errors))


def main_score(json: Column) -> Column:
    return F.get_json_object(json, "$.scores.test[0].main_score").cast("double")
