"""Ingest, and standing questions: what the latest versions answer, asked again on every ingest.

Defined cases: a store without vectors answers nothing; a question asked for the first time hasn't changed; a source is a
git repository if it holds `.git`, else a folder, whose snapshot follows the last one there is.
"""

from __future__ import annotations

import os
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import dense, store
from tarn.operators.store import latest
from tarn.sources.folders import folder_snapshot
from tarn.sources.git import git_changes

BEST = 5


def answers(questions: DataFrame, entries: DataFrame, embedded: DataFrame, k: int = BEST) -> DataFrame:
    """(name, paths): the k paths whose latest version is most like each question (name, vec)."""
    docs = latest(entries).join(embedded, "sid").select(F.col("path").alias("doc_id"), "vec")
    top = dense.topk(questions.withColumnRenamed("name", "query_id"), docs, k)
    paths = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    return top.groupBy(F.col("query_id").alias("name")).agg(paths.alias("paths"))


def changes(new: DataFrame, before: DataFrame) -> DataFrame:
    """new with changed: there was an answer before, and it was another."""
    old = before.select("name", F.col("paths").alias("_before"))
    return new.join(old, "name", "left").withColumn("changed", F.coalesce(F.col("_before") != F.col("paths"), F.lit(False))).drop("_before")


class Ingested(NamedTuple):
    """The store after an ingest, each snapshot's report, and the standing questions' answers."""

    records: DataFrame
    embedded: DataFrame
    report: DataFrame
    answers: DataFrame


def records_of(spark: SparkSession, source: str, index: int = 0) -> DataFrame:
    """(snapshot_index, path, sid, code) of a source: every commit of a repository, or a folder as it is now."""
    if os.path.exists(os.path.join(source, ".git")):
        changes = git_changes(spark, source)
        listed = store.carried_forward(changes, changes.select("snapshot_index").distinct())
    else:
        listed = folder_snapshot(spark, source, os.path.basename(source), 0)
    found = store.with_content_id(listed.select((F.col("snapshot_index") + index).alias("snapshot_index"), "path", "code"))
    return found.select("snapshot_index", "path", "sid", "code")


def ingest(spark: SparkSession, source: str, questions: DataFrame, encode, before: Ingested | None = None) -> Ingested:  # noqa: ANN001
    """Adds a source to the store, encodes contents that it lacks vectors of, and asks the questions (name, vec) again.

    encode takes a list of codes and gives vectors; answers have changed, against those of the ingest before."""
    if before is None:
        records, known = records_of(spark, source), spark.createDataFrame([], "sid string, vec array<float>")
    else:
        last = before.records.agg(F.max("snapshot_index").alias("n")).first()["n"]
        records, known = before.records.unionByName(records_of(spark, source, 0 if last is None else last + 1)), before.embedded
    embedded = store.embed_missing(records.select("sid", "code"), known, encode)
    now = answers(questions, store.chains(records), embedded)
    old = before.answers if before is not None else now.limit(0)
    return Ingested(records, embedded, store.ingest_report(records), changes(now, old.select("name", "paths")))


def watch(spark: SparkSession, folder: str, schema: str, handle, checkpoint: str):  # noqa: ANN001, ANN201
    """Ingest record files as they come to a folder: handle(batch, number) for each micro-batch, until all there is is
    taken. What was taken is kept in the checkpoint folder, so a restart goes on from there."""
    stream = spark.readStream.schema(schema).parquet(folder)
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
