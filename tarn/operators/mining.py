"""Splits, training pairs and hard negatives.

Defined cases: ids that a side lacks fall away, null ones included; a query without negatives has no triple; ties of a
hash go by nothing, as equal ids have equal hashes; either side may be empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_dev_split(ids: DataFrame, key: str, size: int = 500, seed: int = 42) -> DataFrame:
    """ids with split, `dev` for the `size` ids of the smallest seeded hash and `train` for the others.

    The size-th hash is found by a bounded top-k; nothing is sorted as a whole."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rows = ids.withColumn("_digest", digest)
    last = rows.select("_digest").orderBy("_digest").limit(size).agg(F.max("_digest").alias("_last"))
    return rows.crossJoin(F.broadcast(last)).withColumn("split", F.when(F.col("_digest") <= F.col("_last"), "dev").otherwise("train")).drop("_digest", "_last")


def training_pairs(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Relevant pairs with both texts; pairs with a missing side fall away."""
    return qrels.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id").join(corpus.select("doc_id", F.col("text").alias("doc_text")), "doc_id")


def hard_negatives(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query that aren't relevant, with their place among them."""
    return first_negatives(ranked.join(gold.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"), k)


def first_negatives(irrelevant: DataFrame, k: int) -> DataFrame:
    """The k best of ranked documents that are known not to be relevant, with their place among them."""
    return irrelevant.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= k)


def with_neighbours_golds(negatives: DataFrame, neighbours: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, doc_id, place): negatives (query_id, doc_id, place) with the relevant documents of each query's neighbours
    (query_id, other, place: the last one's come first) in front, unless they are relevant to the query itself or
    negatives already. gold: (query_id, doc_id)."""
    own = gold.select("query_id", "doc_id")
    theirs = neighbours.join(own.select(F.col("query_id").alias("other"), "doc_id"), "other").groupBy("query_id", "doc_id").agg(F.min("place").alias("near"))
    new = theirs.join(own, ["query_id", "doc_id"], "left_anti").join(negatives.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    rows = new.select("query_id", "doc_id", (-F.col("near")).alias("order")).unionByName(negatives.select("query_id", "doc_id", F.col("place").alias("order")))
    # in front are orders below 0, the last neighbour's first; documents of one neighbour go by id
    return rows.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("order", "doc_id")).alias("place"))


def cluster_neighbours(similar: DataFrame, low: float = 0.85, high: float = 0.999, first: int = 5) -> DataFrame:
    """Of pairs (query_id, doc_id, score) the first few of each query, by id, that are alike but not the same."""
    near = similar.where((F.col("score") >= low) & (F.col("score") < high) & (F.col("query_id") != F.col("doc_id")))
    return near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).where(F.col("place") <= first)


def triples(pairs: DataFrame, negatives: DataFrame, first: int = 5, seed: int = 7) -> DataFrame:
    """(query_id, positive, negative): each relevant pair with one of its query's first negatives, chosen by hash."""
    few = negatives.where(F.col("place") <= first).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id"))).alias("n"))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("doc_id").cast("string")), 256)
    pick: Column = F.pmod(F.conv(F.substring(digest, 1, 3), 16, 10).cast("int"), F.size("n"))
    return pairs.join(few, "query_id").select("query_id", F.col("doc_id").alias("positive"), F.get("n", pick)["doc_id"].alias("negative"))
