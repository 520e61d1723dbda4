"""Every query of the catalogue against its SQL, run by DuckDB on the same tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tarn.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (np.ndarray, list)):
        return tuple(plain(x) for x in value)
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    return round(float(value), 8) if isinstance(value, (int, float, np.number)) else str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    if name.startswith("op") or name == "pipeline":
        pytest.skip("tested with its operator")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "doc_id", "final", "final_rank"]
    assert out.count() == 10 * spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
