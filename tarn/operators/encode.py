"""Texts to vectors by a model that each worker loads once.

Defined cases: a null text is encoded as a single space, as a blank one is; repeated rows get equal vectors; a model that
can't be loaded raises in the task that needs it, nothing stands in for it; a vector is stored as floats of length one,
or as it is if it has no length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import or_blank

Model = Callable[[list[str]], np.ndarray]
_loaded: dict[str, Model] = {}


def model(name: str, load: Callable[[], Model]) -> Model:
    """The model of a name in this process, loaded when it is first asked for."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def encoder(name: str, load: Callable[[], Model], batch: int = 64) -> Callable[[DataFrame, str, str], DataFrame]:
    """A function of (texts, key, text column) to (key, vec). load runs once in each worker; what it gives takes lists of
    at most `batch` texts and gives their vectors as rows."""

    def encode(texts: DataFrame, key: str, text: str) -> DataFrame:
        kind = dict(texts.dtypes)[key]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for at in range(0, rows.num_rows, batch):
                    part = rows.slice(at, batch)
                    vectors = np.asarray(model(name, load)(part.column(1).to_pylist()), np.float64)
                    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list((vectors / np.where(norms > 0, norms, 1)).astype(np.float32)))], names=[key, "vec"])

        return texts.select(key, or_blank(F.coalesce(text, F.lit(""))).alias("_text")).mapInArrow(run, f"{key} {kind}, vec array<float>")

    return encode
