"""Tables that keep what was worked out: store, vectors, verdicts.

A store's tables are written to a folder of their own and named by a pointer file that is replaced in one step, so that
readers see the old tables or the new ones and a crash at any point leaves one of them; the tables before the last ones
stay for those that still read them. A cache of results is a table that is only added to.

Defined cases: keys are distinct, a null one is worked out each time; nothing wanted gives no rows; a folder without a
store is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """All tables of a store; the pointer moves when the last one is written."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    fs, _ = _fs(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    new, current = path(f"{folder}/_{version}"), path(f"{folder}/CURRENT")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    old = _current(spark, folder)
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    replace = spark.sparkContext._gateway.new_array(options, 1)
    replace[0] = options.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(current), replace)
    for status in fs.listStatus(path(folder)):
        if status.isDirectory() and status.getPath().getName() not in (version, old):
            fs.delete(status.getPath(), True)


def _current(spark: SparkSession, folder: str) -> str | None:
    fs, p = _fs(spark, f"{folder}/CURRENT")
    return spark.sparkContext.wholeTextFiles(f"{folder}/CURRENT").first()[1] if fs.exists(p) else None


def load(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    version = _current(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no store in {folder}")
    return {n: spark.read.parquet(f"{folder}/{version}/{n}") for n in names}


def text_key(text: str = "text"):  # noqa: ANN201
    """Key of a text's vector, whatever batch it came in."""
    return F.sha2(F.col(text), 256)


def cached(spark: SparkSession, wanted: DataFrame, folder: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results for wanted (distinct by keys), those missing from the table in folder worked out and appended."""
    fs, p = _fs(spark, folder)
    have = spark.read.parquet(folder) if fs.exists(p) else None
    todo = wanted.dropDuplicates(keys)
    if have is not None:
        todo = todo.join(have.select(*keys), keys, "left_anti")
    work(todo).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).join(wanted.select(*keys).distinct(), keys, "left_semi")
