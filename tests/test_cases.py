"""Awkward inputs: nulls in any column, empty tables and texts, ties, repeated rows, long texts and clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import text
from tarn.operators import benchmark, compare, dense, encode, examples, metrics, mining, programs, rerank, sandbox, sparse, store, versions
from tarn.plans.engine import Engine
from tarn.sources import tables


def test_dense_cases(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (None, [1.0, 0.0], "x"), (2, None, "x"), (3, [0.0, 1.0], "x")], "doc_id long, vec array<float>, score string")
    q = spark.createDataFrame([(1, [1.0, 0.0], 5), (None, [1.0, 0.0], 5), (9, None, 5)], "query_id long, vec array<float>, rank int")
    got = [(r.query_id, r.doc_id, r.score, r["rank"]) for r in dense.topk(q, docs, 5).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0, 1), (1, 1, 1.0, 2), (1, 3, 0.0, 3)]
    assert [r.doc_id for r in dense.topk(q, docs, 5, apart=True).collect()] == [3]
    assert dense.topk(q, docs.limit(0), 5).count() == 0 == dense.topk(q.limit(0), docs, 5).count()
    each = dense.topk_each(q, docs, 1, [F.lit(0.0), F.when(F.col("doc_id") == 1, 2.0).otherwise(0.0)]).collect()
    assert sorted((r.setting, r.doc_id) for r in each) == [(0, 1), (1, 3)]
    near = dense.neighbours(q, docs, -0.5, 0.5, 5).collect()
    assert [(r.query_id, r.doc_id) for r in near] == [(1, 3)]
    hubs = dense.with_hubs(docs, q.select("vec"), (1, 3))
    assert hubs.columns == ["doc_id", "vec", "score", "hub_1", "hub_3"] and hubs.count() == 4
    assert dense.clean_bank(q.select("query_id"), q.select("query_id").where("query_id = 1")).count() == 2


def test_search_lists_every_document(spark):
    corpus = {"a": "alpha beta", "b": "gamma", "c": "", "d": None, "e": "alpha alpha"}
    rows = spark.createDataFrame([*corpus.items(), (None, "alpha")], "doc_id string, text string").withColumn("score", F.lit("clash"))
    q = spark.createDataFrame([("q", "alpha"), ("none", "unheard of"), ("blank", None), (None, "alpha")], "query_id string, text string")
    got = {}
    for r in sparse.search(q, rows, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score > 0))
    assert got["q"] == [("e", True), ("a", True), ("b", False), ("c", False), ("d", False)]
    assert got["none"] == got["blank"] == [(d, False) for d in "abcde"] and set(got) == {"q", "none", "blank"}
    assert [r.doc_id for r in sparse.search(q, rows, 3).where("query_id = 'q'").orderBy("rank").collect()] == ["e", "a", "b"]
    twice = sparse.search(q, rows.unionByName(rows), 10).where("query_id = 'q' AND rank = 1").first()
    assert twice.doc_id == "e"
    assert sparse.search(q, rows.limit(0), 3).count() == 0 == sparse.search(q.limit(0), rows, 3).count()
    assert Engine(spark).index({k: v or "" for k, v in corpus.items()}).search({"q": "alpha"}, 1000).count() == 5


def test_terms_of_a_long_text(spark):
    df = spark.createDataFrame([(1, "word é " * 40_000 + "x1")], "id long, text string")
    got = {r.term: r.tf for r in sparse.term_counts(df, "id", "text").collect()}
    assert got == {"word": 40_000, "é": 40_000, "x1": 1, "word é": 40_000, "é word": 39_999, "é x1": 1}


def test_metric_cases(spark):
    ranked = spark.createDataFrame([("q", "d", 1), ("q", None, 2), (None, "d", 1)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "d", 1), ("q", "d", 1), ("q", "e", 0), (None, "d", 1), ("r", None, 1)], "query_id string, doc_id string, relevance int")
    one = metrics.retrieval(ranked, qrels, (1,)).first()
    assert (one.k, one.ndcg) == (1, round(1 / 3, 5))  # of three queries with judgments one has a hit
    assert metrics.retrieval(ranked, qrels.limit(0)).count() == 0 == metrics.rank_of_gold(ranked, qrels.limit(0)).count()
    swept = spark.createDataFrame([(0.0, 0.5, 3), (0.1, 0.5, 1), (0.2, 0.4, 0)], "tau double, ndcg double, extended int")
    best = metrics.adopted(swept, "tau", "ndcg", 0.5, "extended").first()
    assert (best.tau, best.gain, best.decision) == (0.1, 0.0, "REJECT")
    assert metrics.adopted(swept.withColumn("ndcg", F.col("tau")), "tau", "ndcg", 0.1).first().decision == "ADOPT"


def test_rerank_and_mining_cases(spark):
    ranked = spark.createDataFrame([("q", "a", 0.5, 1), ("q", "b", 0.5, 2), ("one", "a", None, 1)], "query_id string, doc_id string, score double, rank int").withColumn("m", F.lit("clash"))
    m = {r.query_id: r.margin for r in rerank.margins(ranked).collect()}
    assert m == {"q": 0.0, "one": None}
    assert {r.norm for r in rerank.min_max(ranked.where("query_id = 'q'")).collect()} == {1.0}
    v = spark.createDataFrame([("q", "a", 1, None), ("q", "b", None, 0)], "query_id string, doc_id string, passed int, total int")
    assert [r.conf for r in rerank.with_confidence(v).collect()] == [0.0, 0.0]
    gold = spark.createDataFrame([("q", "a"), (None, "b")], "query_id string, doc_id string")
    negatives = mining.hard_negatives(ranked, gold, 5)
    assert sorted((r.query_id, r.doc_id) for r in negatives.collect()) == [("one", "a"), ("q", "b")]
    assert [tuple(r) for r in mining.triples(gold, negatives).collect()] == [("q", "a", "b")]
    near = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, other string, place int")
    golds = spark.createDataFrame([("q", "a"), ("x", "g1"), ("x", "a"), ("y", "g2"), ("y", "b"), ("y", "g1")], "query_id string, doc_id string")
    out = mining.with_neighbours_golds(negatives.where("query_id = 'q'"), near, golds).orderBy("place").collect()
    assert [r.doc_id for r in out] == ["g2", "g1", "b"]
    assert mining.in_dev_split(gold.limit(0), "query_id").count() == 0


def test_program_cases(spark):
    df = spark.createDataFrame([(None, "a"), ("", "b"), ("print(1)", "c"), ("print(1)", "c"), ("x" + "+x" * 3000, "d")], "code string, input_calls string")
    signed = programs.with_signature(df.withColumnRenamed("input_calls", "doc_id"))
    assert [r.io_shape for r in signed.orderBy("doc_id").collect()][:2] == ["unknown", "unknown"] and signed.count() == 5
    pairs = df.select(F.lit("q").alias("query_id"), F.col("input_calls").alias("doc_id"), "code", F.lit(None).cast("array<struct<stdin:string,expected:string,idx:int>>").alias("examples"), F.lit(None).cast("boolean").alias("any_order"))
    assert {(r.passed, r.total, r.first_status) for r in sandbox.verify_pairs(pairs).collect()} == {(0, 0, None)}
    assert sandbox.verify_pairs(pairs.limit(0)).count() == 0
    assert [r.naive for r in benchmark.with_naive(pairs).collect()] == [False] * 5
    assert versions.probes("") and versions.probes("x") and len(versions.probes("1 " * 20_000)) == 8
    assert {r.method for r in store.with_content_id(df).collect()} <= {"ast", "text"}
    assert store.with_content_id(df.limit(0)).count() == 0


def test_statement_and_text_cases(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("Input\n" * 20_000, 3), ("Sample Input 1\n1\nSample Output 1\n2", 4)], "text string, reason int")
    got = examples.with_examples(df.withColumnRenamed("reason", "id")).orderBy("id").collect()
    assert [r.reason for r in got][:2] == ["empty_statement"] * 2 and [len(r.examples) for r in got] == [0, 0, 0, 1]
    assert [r[0] for r in df.select(text.or_blank(F.coalesce("text", F.lit("")))).collect()][:2] == [" ", " "]
    c = df.select(compare.tokens_match(F.col("text"), F.col("text")).alias("same")).collect()
    assert c[1].same and c[2].same
    assert compare.compare("1 " * 50_000, "1 " * 50_000)[0]


def test_versions_of_one_and_none(spark):
    v = spark.createDataFrame([("q", 1, None, None, None, None, None), ("q", 2, None, None, 0, 0, None)], "query_id string, idx int, digest string, outputs array<string>, passed int, total int, trace double").withColumn("blended", F.lit(None).cast("double"))
    out = versions.ranked(versions.with_consensus(versions.inherited(v))).collect()
    assert sorted(r["rank"] for r in out) == [1, 2] and {r.consensus for r in out} == {0.0}
    assert versions.ranked(versions.with_consensus(versions.inherited(v.limit(0)))).count() == 0


def test_encoders(spark):
    def broken():
        raise RuntimeError("no model")

    def lengths():
        return lambda texts: np.array([[len(t), 0.0] for t in texts])

    df = spark.createDataFrame([("a", "xyz"), ("b", None), ("c", "")], "id string, text string")
    got = {r.id: r.vec for r in encode.encoder("lengths", lengths, 2)(df, "id", "text").collect()}
    assert got == {"a": [1.0, 0.0], "b": [1.0, 0.0], "c": [1.0, 0.0]}
    with pytest.raises(Exception, match="no model"):
        encode.encoder("broken", broken)(df, "id", "text").collect()
    assert encode.encoder("lengths", lengths)(df.limit(0), "id", "text").count() == 0


def test_table_cases(spark):
    q = spark.createDataFrame([(None, 2, None), (1, None, 0)], "query_id int, corpus_id int, score int")
    assert [tuple(r) for r in tables.judgments(q).collect()] == [(None, "2", 1), ("1", None, 0)]
    assert tables.texts(spark, spark.createDataFrame([(1, None, "x")], "id int, text string, other string")).columns == ["doc_id", "text"]
