"""Task results as JSON files.

Defined cases: dates, sets and numpy values are written as plain ones; a file that isn't a valid result is read with its
errors, not refused; a missing main score is null.
"""

from __future__ import annotations

import datetime
import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.metrics import main_score, result_errors


def _plain(x: Any) -> Any:
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    if isinstance(x, (set, frozenset, tuple)):
        return sorted(x) if isinstance(x, (set, frozenset)) else list(x)
    return x.item() if hasattr(x, "item") else x.tolist() if hasattr(x, "tolist") else str(x)


def result(task: str, scores: dict[str, float], revision: str, version: str, seconds: float, extra: dict | None = None) -> dict:
    """A task result of one split; what isn't part of its form goes under one key of its own."""
    row = {**scores, "main_score": scores["ndcg_at_10"], "hf_subset": "default", "languages": ["eng-Latn", "python-Code"]}
    out = {"dataset_revision": revision, "task_name": task, "mteb_version": version, "evaluation_time": seconds, "scores": {"test": [row]}}
    return out | ({"extra": extra} if extra else {})


def save(value: dict, path: str) -> None:
    """Written beside and then moved there."""
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, default=_plain)
    os.replace(path + ".new", path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, json, errors, main_score) of each result file."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return files.select("path", F.col("value").alias("json"), result_errors(F.col("value")).alias("errors"), main_score(F.col("value")).alias("main_score"))
