"""Queries, corpora and relevance judgments, from tables or small containers.

Defined cases: ids become strings, null ones stay null; a missing relevance is 1; repeated rows stay; columns besides ids
and texts are left behind; an empty container is an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(spark: SparkSession, data: DataFrame | Mapping | Iterable, key: str = "doc_id") -> DataFrame:
    """(key, text) of a DataFrame with id or _id and text, of a mapping, or of a list of texts (numbered) or of records.

    Nothing but ids and texts passes on: scoring may see no more."""
    if isinstance(data, DataFrame):
        name = next(c for c in (key, "id", "_id") if c in data.columns)
        return data.select(F.col(name).cast("string").alias(key), "text")
    if isinstance(data, Mapping):
        rows = [(str(k), v) for k, v in data.items()]
    else:
        rows = [(str(x.get("id", x.get("_id"))), x["text"]) if isinstance(x, Mapping) else (str(i), x) for i, x in enumerate(data)]
    return spark.createDataFrame(rows, f"{key} string, text string")


def judgments(data: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance) by name, else by place; a missing relevance is 1."""
    names = {c.lower().replace("-", "_"): c for c in data.columns}
    query = names.get("query_id", data.columns[0])
    doc = names.get("corpus_id", names.get("doc_id", data.columns[1]))
    score = names.get("score", names.get("relevance"))
    value = F.coalesce(F.col(score).cast("int"), F.lit(1)) if score else F.lit(1)
    return data.select(F.col(query).cast("string").alias("query_id"), F.col(doc).cast("string").alias("doc_id"), value.alias("relevance"))


def dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four tables of a retrieval dataset in a folder."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    return {
        "queries": texts(spark, read("queries"), "query_id"), "corpus": texts(spark, read("corpus")),
        "train": judgments(read("qrels_train")), "test": judgments(read("qrels_test")),
    }


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return queries.join(qrels.select("query_id"), "query_id", "left_semi")
