"""The engine: index a corpus, search it, retrieve with verification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.shapes import example_shape
from tarn.functions.text import allows_any_order, normalise_query, or_blank, strip_boilerplate
from tarn.operators import dense, examples, programs, rerank, sandbox, sparse
from tarn.sources import caches
from tarn.sources.tables import texts

Encoder = Callable[[DataFrame, str, str], DataFrame]


class Engine:
    """index(corpus), then search or retrieve.

    encoder: (texts, key, text column) to (key, vec); without one ranking is by TF-IDF. An encoder that fails raises:
    there is no silent change to the other one.
    verdicts: a folder that keeps verdicts by statement and program; only pairs that it lacks are run.
    demote: a column of the encoded corpus (such as hub times beta) to take from every similarity."""

    def __init__(self, spark: SparkSession, encoder: Encoder | None = None, demote: str | None = None, alpha: float = 0.2, tau: float | None = None, base: int = 150, extend: int = 500, verdicts: str | None = None) -> None:
        self.spark, self.encoder, self.demote = spark, encoder, demote
        self.alpha, self.tau, self.base, self.extend, self.verdicts = alpha, tau, base, extend, verdicts

    def index(self, corpus: DataFrame | dict | list) -> Engine:
        raw = texts(self.spark, corpus)
        self.corpus = raw.select("doc_id", F.col("text").alias("text_raw"), or_blank(strip_boilerplate(F.col("text"))).alias("text_stripped"))
        self.vectors = self.encoder(self.corpus, "doc_id", "text_stripped") if self.encoder else None
        return self

    def search(self, queries: DataFrame | dict | list, top_k: int = 1000) -> DataFrame:
        """query_id, doc_id, score, rank"""
        q = texts(self.spark, queries, "query_id").withColumn("text", or_blank(normalise_query(F.col("text"))))
        if self.encoder:
            return dense.topk(self.encoder(q, "query_id", "text"), self.vectors, top_k, minus=self.demote)
        return sparse.search(q, self.corpus, top_k, text_doc="text_stripped")

    def retrieve(self, queries: DataFrame | dict | list, top_k: int = 10) -> DataFrame:
        """The best documents after verification: query_id, doc_id, final_rank, final, conf, passed, total and badge."""
        q = texts(self.spark, queries, "query_id")
        pool = self.search(q, max(1000, self.base))
        parsed = examples.with_examples(q).withColumn("any_order", allows_any_order(F.col("text"))).select("query_id", "examples", "any_order")
        margin = rerank.margins(pool)
        fits = None
        if self.tau is not None:
            shapes = parsed.where(F.size("examples") > 0).select("query_id", example_shape(F.get("examples", F.lit(0))["stdin"]).alias("shape"))
            ok = programs.gate(programs.with_signature(self.corpus, "text_raw"), shapes).withColumn("ok", F.lit(True))
            judged = pool.select("query_id", "doc_id").join(shapes.select("query_id"), "query_id", "left_semi")
            fits = judged.join(ok, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("ok", F.lit(False)).alias("fits"))
        candidates = rerank.gated(pool, margin, self.tau if self.tau is not None else float("-inf"), self.base, self.extend, fits)
        work = candidates.join(parsed.where(F.size("examples") > 0), "query_id").join(self.corpus.select("doc_id", F.col("text_raw").alias("code")), "doc_id")
        verdicts = rerank.with_confidence(self._verified(work.select("query_id", "doc_id", "code", "examples", "any_order")))
        out = rerank.blend(pool, verdicts, self.alpha).join(verdicts.select("query_id", "doc_id", "passed", "total"), ["query_id", "doc_id"], "left")
        badge = F.when(F.col("total") > 0, F.concat(F.when(F.col("passed") == F.col("total"), "PASSED ").otherwise("FAILED "), F.col("passed").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" examples"))).otherwise("unverified")
        return out.where(F.col("final_rank") <= top_k).select("query_id", "doc_id", "final_rank", "final", "conf", "passed", "total", badge.alias("badge"))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs with verdicts. Those of a folder are looked up by what a verdict depends on: examples, order and program."""
        if self.verdicts is None:
            return sandbox.verify_pairs(pairs)
        keys = ["query_key", "code_key"]
        keyed = pairs.withColumns({"query_key": F.sha2(F.concat(F.to_json("examples"), F.col("any_order").cast("string")), 256), "code_key": F.sha2("code", 256)})

        def work(missing: DataFrame) -> DataFrame:
            named = missing.withColumns({"query_id": F.col("query_key"), "doc_id": F.col("code_key")})
            return sandbox.verify_pairs(named.select("query_id", "doc_id", "code", "examples", "any_order")).withColumnsRenamed({"query_id": "query_key", "doc_id": "code_key"})

        found = caches.cached(self.spark, keyed.select(*keys, "code", "examples", "any_order"), self.verdicts, keys, work)
        return keyed.select("query_id", "doc_id", *keys).join(found, keys).drop(*keys)
