"""Operators on small inputs: parsing, comparison, execution, ranking, and properties that must hold."""

import math

import pytest
from pyspark.sql import functions as F

from tarn.functions import text
from tarn.operators import benchmark, compare, dense, examples, metrics, mining, programs, rerank, sandbox, store, versions
from tarn.plans.engine import Engine
from tarn.plans.fixtures import COMPARED, PAIR_SUM, PROGRAMS, _REASONS

CODE = dict(PROGRAMS)


def test_comparison_reasons():
    for (_, a, e, any_order), reason in zip(COMPARED, _REASONS, strict=True):
        assert compare.compare(a, e, any_order)[1] == reason


def test_parser_layouts():
    assert examples.parse("-----Examples-----\nInput\n3\n1 2 3\n\nOutput\n6\n\n-----Note-----\nSum.\n") == ("codeforces", "", [("3\n1 2 3\n", "6\n")])
    assert examples.parse("See [Image].")[1] == "image_only_or_no_example_section"
    assert examples.parse("An example of prose.")[1] in ("bare_markers_unusable", "example_section_unparsed")
    assert examples.parse(None)[1] == "empty_statement"


def test_python_literals_and_long_text():
    assert compare.compare("[" + "1," * 15_000 + "]", "x")[0] is False
    assert compare.compare("nan", "nan")[1] == "exact_match"


def test_sandbox_statuses():
    assert sandbox.run(CODE["p_dbl"], "21\n", "42").matched
    called = sandbox.run(CODE["p_cls"], "15 25", "40")
    assert (called.matched, called.mode) == (True, "call")
    assert sandbox.run(CODE["p_exit"], "", "DONE").matched
    assert sandbox.run(CODE["p_bad"], "").status == "syntax_error"
    assert sandbox.run("import sys\nsys.exit(3)", "").status == "error"
    assert sandbox.run("x = 1", "").status == "empty_output"
    assert sandbox.run(CODE["p_fd"], "6 7\n", "42").matched
    assert sandbox.run("class Solution:\n    def two(self, nums, target):\n        return [0, 1]", "nums = [2, 7], target = 9", "[0,1]").matched


def test_patience_ends():
    p = sandbox.Patience()
    assert [p.run(CODE["p_loop"], "").status for _ in range(5)] == ["timeout"] * 4 + ["timeout_skipped"]


def test_verification_stops_and_retries():
    p = sandbox.Patience()
    runs = sandbox.verify("print(1 // 0)", [("", "1"), ("", "1")], False, p)
    assert [r.status for r in runs] == ["error"]
    assert [r.matched for r in sandbox.verify(CODE["p_sq"], [("3\n", "9"), ("4\n", "15"), ("5\n", "25")], False, p)] == [True, False, True]
    blank = sandbox.verify(CODE["p_sum"], [("2\n\n1 2\n\n3 4\n", "3\n7")], False, p)
    assert blank[0].matched


def test_trace_and_repair():
    assert "45" in sandbox.run("n = int(input())\nm = n * 5\nprint(m)", "9\n", trace=True).values
    assert programs.runnable("print 'a'\n")[0].strip() == "print('a')"
    assert "__tarn_main__" in programs.runnable("x = 1\nreturn\n")[0]
    assert programs.entry_point("class Solution:\n    def help(self): pass\n    def go(self): return self.help()") == {"cls": "Solution", "names": ["go", "help"]}


def test_faulty_and_cosmetic_versions():
    code = "n = int(input())\nfor i in range(n):\n    if i <= 3:\n        print(i + 1)\n"
    changed = {benchmark.faulty(code, s) for s in range(30)}
    assert len(changed) > 2 and code not in changed and all(programs.runnable(c)[0] for c in changed)
    assert benchmark.faulty("pass", 1) is None and benchmark.faulty("def f(:", 1) is None
    assert all(store.normalised(c) != store.normalised(code) for c in changed)
    assert store.normalised(benchmark.cosmetic(code, 3)) == store.normalised(code)


def test_probes_keep_the_layout():
    got = versions.probes("3\n1 2\n3 4\n5 6\n")
    assert len(got) == 8 and got[0] == "3\n1 2\n3 4\n5 6\n"
    assert all(p.split("\n")[0] == "3" and [len(x.split()) for x in p.strip().split("\n")] == [1, 2, 2, 2] for p in got)
    assert versions.probes("3\n1 2\n3 4\n5 6\n") == got


def test_top_k_ties_and_identity(spark):
    docs = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("n", None)], "doc_id string, vec array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vec array<float>")
    assert [r.doc_id for r in dense.topk(q, docs, 2).orderBy("rank").collect()] == ["a", "b"]
    hubs = dense.with_hubs(docs, q.select("vec"), 3).withColumn("zero", F.col("hub") * 0.0)
    plain = dense.topk(q, docs, 3).orderBy("rank").collect()
    assert dense.topk(q, hubs, 3, minus="zero").orderBy("rank").collect() == plain
    assert dense.topk(q.limit(0), docs, 3).count() == 0


def test_blocks_of_queries_give_the_same(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
    q, d = e.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "doc_id")
    assert sorted(dense.topk(q, d, 3).collect()) == sorted(dense.topk(q, d, 3, block=7).collect())


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 11)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "d2", 1), ("none", "d1", 1)], "query_id string, doc_id string, relevance int")
    r = {x.k: x for x in metrics.retrieval(ranked, qrels, (1, 10)).collect()}
    assert (r[1].recall, r[10].mrr, r[10].map) == (0.0, 0.25, 0.25)
    assert r[10].ndcg == round(0.5 / math.log2(3), 5)


def test_alpha_zero_keeps_the_order(spark):
    ranked = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 2), ("q", "c", 0.2, 3)], "query_id string, doc_id string, score double, rank int")
    v = rerank.with_confidence(spark.createDataFrame([("q", "b", 1, 1), ("q", "a", 0, 1)], "query_id string, doc_id string, passed int, total int"))
    assert [r.doc_id for r in rerank.blend(ranked, v, 0.0).orderBy("final_rank").collect()] == ["a", "b", "c"]
    out = rerank.blend(ranked, v, 0.35).orderBy("final_rank").collect()
    assert [(r.doc_id, r.final) for r in out] == [("b", 1.20714), ("a", 1.0), ("c", 0.0)]
    assert sorted(rerank.restricted(v, v).collect()) == sorted(v.collect())


def test_store_counts(spark):
    r = spark.createDataFrame([(0, "p", "A"), (1, "p", "A"), (2, "p", "B"), (3, "p", "A"), (3, "q", "B")], "snapshot_index int, path string, sid string")
    assert [(x.n_new, x.n_unchanged) for x in store.ingest_report(r).orderBy("snapshot_index").collect()] == [(1, 0), (0, 1), (1, 0), (0, 2)]
    assert [x.sid for x in store.chains(r).where("path = 'p'").orderBy("snapshot_index").collect()] == ["A", "B", "A"]
    assert store.normalised("def f():\n  'doc'\n  return 1")[0] == store.normalised("def f():\n  return 1  # x")[0]
    assert store.normalised("print x  # py2\n") == ("print x", "text")


def test_negatives(spark):
    ranked = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 5)], "query_id string, doc_id string, rank int")
    gold = spark.createDataFrame([("q", "d1")], "query_id string, doc_id string")
    assert [r.doc_id for r in mining.hard_negatives(ranked, gold, 2).orderBy("place").collect()] == ["d2", "d3"]
    assert mining.triples(gold, mining.hard_negatives(ranked, gold, 2)).first().negative in ("d2", "d3")


def test_text_columns(spark):
    df = spark.createDataFrame([("import sys\n\n\n\nx = 1",), (None,)], "t string")
    assert [r[0] for r in df.select(text.strip_boilerplate(F.col("t"))).collect()] == ["x = 1", ""]
    assert df.select(text.with_bigrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).first()[0] == ["a", "b", "c", "a b", "b c"]
    assert df.select(text.with_bigrams(F.array().cast("array<string>"))).first()[0] == []


def test_failing_encoder_isn_t_replaced(spark):
    def broken(*_):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        Engine(spark, encoder=broken).index({"a": "x"})


def test_gated_retrieval(spark):
    corpus = {k: v for k, v in CODE.items() if k in ("p_sum", "p_sq", "p_tc", "p_rev")}
    out = Engine(spark, alpha=3.0, tau=2.0, base=1, extend=4).index(corpus).retrieve({"s": "a b int input split\n" + PAIR_SUM}, 4)
    got = {r.doc_id: r.badge for r in out.collect()}
    assert got["p_sum"] == "PASSED 1/1 examples"
    assert got["p_sq"] == "unverified" or got["p_sq"].startswith("FAILED")


def test_blocks_of_the_bank_give_the_same(spark):
    r = __import__("random").Random(4)
    docs = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(30)], "doc_id long, vec array<double>")
    bank = spark.createDataFrame([([r.gauss(0, 1) for _ in range(4)],) for _ in range(22)] + [([0.1] * 4,)] * 3 + [(None,)], "vec array<double>")
    for k in (3, 40):
        got = dense.with_hubs(docs, bank, k, block=8)
        assert got.columns == ["doc_id", "vec", "hub"]
        assert sorted(got.select("doc_id", F.round("hub", 9)).collect()) == sorted(dense.with_hubs(docs, bank, k).select("doc_id", F.round("hub", 9)).collect())
    got, want = (sorted(dense.with_log_mass(docs, bank, block=b).select("doc_id", F.round("log_mass", 9)).collect()) for b in (8, 4096))
    assert got == want
