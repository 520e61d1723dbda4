"""Snapshots of folders of code.

Defined cases: an empty folder gives no rows; an empty file is an empty program; bytes that aren't UTF-8 become
replacement characters; of two folders the order given is that of the snapshots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = ("__pycache__", "node_modules")


def folder_snapshot(spark: SparkSession, folder: str, label: str, index: int = 0, suffix: str = ".py") -> DataFrame:
    """(snapshot_index, ref, source, path, code, ts) of the files under a folder.

    Hidden folders and those in SKIPPED are left out; bytes that aren't UTF-8 become replacement characters."""
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    relative = F.substring_index(path, root + "/", -1) if "://" in root else F.replace(path, F.lit(root + "/"), F.lit(""))
    parts = F.split(relative, "/")
    above = F.slice(parts, 1, F.size(parts) - 1)
    rows = files.select(relative.alias("path"), above.alias("_above"), F.col("modificationTime").cast("double").alias("ts"), F.col("content"))
    kept = rows.where(~F.exists("_above", lambda d: d.startswith(".") | d.isin(*SKIPPED)))
    return kept.select(F.lit(index).alias("snapshot_index"), F.lit(label).alias("ref"), F.lit("folder").alias("source"), "path", _text("content").alias("code"), "ts")


def _text(content: str):  # noqa: ANN202
    """UTF-8 with replacement characters instead of an error."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def folder_series(spark: SparkSession, folders: list[tuple[str, str]]) -> DataFrame:
    """Snapshots of (folder, label) one after the other."""
    return reduce(DataFrame.unionByName, [folder_snapshot(spark, f, label, i) for i, (f, label) in enumerate(folders)])
