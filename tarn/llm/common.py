"""What the operators of this subpackage share: reading tables, row batches and lineage cuts."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_all_cores(df: DataFrame) -> DataFrame:
    """df, dealt anew if it is so small that it has fewer partitions than there are cores. What Python does to each row
    costs far more than that; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def folder(spark: SparkSession) -> str:
    """The shared folder for what cuts lineage: spark.checkpoint.dir. Its files go when the driver ends.

    Without the setting a local session (as in tests) gets a temporary folder; on a cluster that is an error, as other
    machines couldn't read it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="tarn-checkpoint-")
        context.setCheckpointDir(path)
    _delete_at_end(spark, context.getCheckpointDir())
    return context.getCheckpointDir()


def _delete_at_end(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the cluster's checkpoint folder and read from there afterwards."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the checkpoint folder and read again.

    For tables of many rows, which this keeps several times smaller than a checkpoint."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tarn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 500


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in small parts, so that few texts are Python objects at once; empty ones are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def remainder(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id's decimal text modulo modulus; a null id counts as an empty text (0)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def remainder_column(doc_id: Any, modulus: int) -> Any:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column's texts; null is the empty text."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def map_texts(df: DataFrame, columns: list[str], per_batch: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """per_batch over the Arrow batches of some columns of df; it returns a list of values for each field of schema."""
    from pyspark.sql.types import _parse_datatype_string

    arrow = _arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values = per_batch(batch)
            yield pa.RecordBatch.from_arrays([_array(values[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def _array(values: Any, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def _arrow_schema(struct: Any) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)
