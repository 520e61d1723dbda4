"""TF-IDF retrieval in long form: (id, term, weight) rows, joined on terms.

Weights: term frequency 1 + ln(tf), inverse document frequency ln((1 + n) / (1 + df)) + 1 over the corpus, L2 norm.
A text is cut into terms in Python, batch by batch, and its terms are counted there, so no shuffle is needed for tf.
A search first keeps the terms that some query has; documents' other terms only go into their norms. Queries' terms are
broadcast if they are at most QUERY_TERMS rows; more are joined by shuffle, where adaptive execution splits frequent
terms.

Defined cases: a null or empty text has no terms, its document is found with score 0 only; a null id is an id like any
other in counts, and isn't searched; a repeated id has its texts' terms added up; either side may be empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import TERM

QUERY_TERMS = 1_000_000
#: Texts that are cut at a time.
_SLICE = 200


def _in_rows(texts: DataFrame, key: str, text: str, bigrams: bool) -> DataFrame:
    """(id, term, tf) of each row on its own; terms are lower-cased words, numbers and single other characters."""
    kind = dict(texts.dtypes)[key]
    cut = re.compile(TERM, re.ASCII)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                places: list[int] = []
                terms: list[str] = []
                tf: list[int] = []
                for i, t in enumerate(part.column(1).to_pylist()):
                    words = cut.findall(t) if t else []
                    counts = Counter(words)
                    if bigrams:
                        counts.update([f"{a} {b}" for a, b in pairwise(words)])
                    places += [i] * len(counts)
                    terms += counts
                    tf += counts.values()
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(places, pa.int32())), pa.array(terms, pa.string()), pa.array(tf, pa.int64())], names=["id", "term", "tf"])

    # lower-casing is Spark's, as in SQL
    return texts.select(F.col(key).alias("id"), F.lower(text).alias("text")).mapInArrow(count, f"id {kind}, term string, tf bigint")


def term_counts(texts: DataFrame, key: str, text: str, bigrams: bool = True) -> DataFrame:
    """(id, term, tf)"""
    return _in_rows(texts, key, text, bigrams).groupBy("id", "term").agg(F.sum("tf").alias("tf"))


def inverse_frequencies(counts: DataFrame, n_docs: int, max_terms: int | None = None) -> DataFrame:
    """(term, df, idf); max_terms: only the terms of most occurrences, ties in the order of terms."""
    terms_ = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
    if max_terms is not None:
        terms_ = terms_.orderBy(F.desc("n"), "term").limit(max_terms)
    return terms_.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def _raw(counts: DataFrame, idf: DataFrame) -> DataFrame:
    return counts.join(idf.select("term", "idf"), "term").select("id", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))


def norms(counts: DataFrame, idf: DataFrame, n_docs: int | None = None) -> DataFrame:
    """(id, norm). n_docs: of a corpus whose own counts these are, all terms in it; terms of one document, most of all,
    then have one idf and needn't be joined."""
    if n_docs is None:
        raw = _raw(counts, idf).select("id", "w")
    else:
        once = F.lit(math.log((1.0 + n_docs) / 2.0) + 1.0)
        raw = counts.join(idf.where("df > 1").select("term", "idf"), "term", "left").select("id", ((1.0 + F.log("tf")) * F.coalesce("idf", once)).alias("w"))
    return raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, term, weight), each id's weights of norm 1; terms that the corpus lacks fall away."""
    return _raw(counts, idf).join(norms(counts, idf), "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def topk(query_weights: DataFrame, doc_weights: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, doc_id, score, rank; documents that share no term with a query aren't listed."""
    q = query_weights.select(F.col("id").alias("query_id"), "term", F.col("weight").alias("wq"))
    if q.limit(QUERY_TERMS + 1).count() <= QUERY_TERMS:
        q = F.broadcast(q)
    scores = doc_weights.join(q, "term").groupBy("query_id", F.col("id").alias("doc_id")).agg(F.round(F.sum(F.col("wq") * F.col("weight")), digits).alias("score"))
    return _best(scores, k)


def filled(found: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """found (query_id, doc_id, score, rank) with documents of score 0 behind, by id, where a query has fewer than k.

    Of the first k documents by id at least as many as are missing aren't found yet, so no others are looked at."""
    first = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy("doc_id").limit(k)
    short = queries.select("query_id").distinct().join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id")
    more = short.crossJoin(F.broadcast(first)).join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return _best(found.drop("rank").unionByName(more.select("query_id", "doc_id", F.lit(0.0).alias("score"))), k)


def search(queries: DataFrame, corpus: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id", text: str = "text", bigrams: bool = True, max_terms: int | None = None, text_doc: str | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query, all of them if there are fewer."""
    queries, corpus = queries.where(F.col(query).isNotNull()), corpus.where(F.col(doc).isNotNull())
    kinds = dict(corpus.dtypes)[doc], dict(queries.dtypes)[query]
    ids = corpus.agg(F.count("*").alias("n"), F.count_distinct(doc).alias("ids")).first()
    # an id that occurs once has its counts complete where its row is read
    count = _in_rows if ids["n"] == ids["ids"] else term_counts
    if (cores := corpus.sparkSession.sparkContext.defaultParallelism) > corpus.rdd.getNumPartitions():
        corpus = corpus.select(doc, text_doc or text).repartition(cores)  # a small input is cut into terms by all cores
    counts = count(corpus, doc, text_doc or text, bigrams)
    idf = inverse_frequencies(counts, ids["n"], max_terms)
    asked = term_counts(queries, query, text, bigrams)
    terms = asked.select("term").distinct()
    if terms.limit(QUERY_TERMS + 1).count() <= QUERY_TERMS:
        terms = F.broadcast(terms)
    wanted = idf.join(terms, "term", "left_semi")
    some = _raw(counts.join(terms, "term", "left_semi"), wanted)
    doc_weights = some.join(norms(counts, idf, ids["n"] if max_terms is None else None), "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))
    found = topk(weights(asked, wanted), doc_weights, k)
    found = found.select(F.col("query_id").cast(kinds[1]), F.col("doc_id").cast(kinds[0]), "score", "rank")
    return filled(found, queries.select(F.col(query).alias("query_id")), corpus.select(F.col(doc).alias("doc_id")), k)
