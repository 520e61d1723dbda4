"""Dense retrieval: brute force in blocks of queries, hubs, demotion and inverted softmax.

A block of queries (or the bank) is collected and broadcast as a matrix of at most BLOCK rows, whatever the number of
queries: more rows make more blocks. Documents stream past it in Arrow batches; each task passes on only the k best of
its documents for each query, so what is shuffled is k rows a query and task, never the pairs.
Scores are summed in double precision and rounded before ranking; ties go by document id.

Defined cases: rows with a null vector or id take no part; a repeated id is listed as often as its rows are among the
best; fewer documents than asked for are all listed; either side may be empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, DIGITS = 4096, 5


def rounded(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    scaled = np.abs(x) * 10.0**digits
    return np.copysign(np.floor(scaled + 0.5), x) / 10.0**digits + 0.0


def _blocks(rows: DataFrame, key: str, block: int) -> list[DataFrame]:
    parts = -(-rows.count() // block) or 1
    return [rows] if parts == 1 else [rows.where(F.pmod(F.xxhash64(key), F.lit(2 * parts)) == i) for i in range(2 * parts)]


def _matrix(batch: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles."""
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(batch), -1)


def _collected(rows: DataFrame) -> tuple[list, np.ndarray]:
    got = rows.collect()
    return [r[0] for r in got], np.array([r[1] for r in got], np.float64)


def topk(queries: DataFrame, docs: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id", vec: str = "vec", minus: str | None = None, digits: int = DIGITS, block: int = BLOCK, apart: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query.

    minus: a column of docs that is taken from each of its similarities first. apart: a document of the query's own id
    isn't listed."""
    taken = [F.col(minus)] if minus else [F.lit(0.0)]
    return topk_each(queries, docs, k, taken, query, doc, vec, digits, block, apart).drop("setting")


def topk_each(queries: DataFrame, docs: DataFrame, k: int, minus: list[Column], query: str = "query_id", doc: str = "doc_id", vec: str = "vec", digits: int = DIGITS, block: int = BLOCK, apart: bool = False) -> DataFrame:
    """The same for several settings at once, with setting, the number of what is taken from the similarities: these are
    worked out once for all."""
    queries = queries.select(query, vec).where(F.col(vec).isNotNull() & F.col(query).isNotNull())
    docs = docs.select(F.col(doc).alias("doc_id"), F.col(vec).alias("vec"), F.array(*minus).cast("array<double>").alias("minus")).where("vec IS NOT NULL AND doc_id IS NOT NULL")
    kind, doc_kind = dict(queries.dtypes)[query], dict(docs.dtypes)["doc_id"]
    parts = []
    for part in _blocks(queries, query, block):
        ids, matrix = _collected(part)
        if ids:
            parts.append(_block_topk(docs, ids, matrix, k, digits, f"setting int, query_id {kind}, doc_id {doc_kind}, score double", len(minus), apart))
    if not parts:
        return docs.sparkSession.createDataFrame([], f"setting int, query_id {kind}, doc_id {doc_kind}, score double, rank int")
    together = reduce(DataFrame.unionByName, parts)
    best = Window.partitionBy("setting", "query_id").orderBy(F.desc("score"), "doc_id")
    return together.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _block_topk(docs: DataFrame, ids: list, matrix: np.ndarray, k: int, digits: int, schema: str, settings: int, apart: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        names = np.array(ids)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((len(ids), 0)), np.zeros((len(ids), 0)))] * settings
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False)
            raw, minus = matrix @ _matrix(batch.column(1)).T, _matrix(batch.column(2))
            itself = own[None, :] == names[:, None] if apart else None
            for n in range(settings):
                s = rounded(raw - minus[:, n], digits)
                if apart:
                    s[itself] = -np.inf
                d = np.broadcast_to(own, s.shape)
                if best[n][0].shape[1]:
                    s, d = np.concatenate([best[n][0], s], axis=1), np.concatenate([best[n][1], d], axis=1)
                if s.shape[1] > k:
                    order = np.lexsort((d, -s), axis=1)[:, :k]
                    s, d = np.take_along_axis(s, order, axis=1), np.take_along_axis(d, order, axis=1)
                best[n] = s, d
        for n, (s, d) in enumerate(best):
            there = np.isfinite(s)
            if there.any():
                q = np.broadcast_to(names[:, None], s.shape)[there]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), n, np.int32)), pa.array(q), pa.array(d[there]), pa.array(s[there])], names=["setting", "query_id", "doc_id", "score"])

    return docs.mapInArrow(run, schema)


def neighbours(queries: DataFrame, docs: DataFrame, low: float, high: float, first: int, query: str = "query_id", doc: str = "doc_id", vec: str = "vec", digits: int = DIGITS, block: int = BLOCK) -> DataFrame:
    """query_id, doc_id, score, place: of each query the first documents by id, itself apart, with low <= score < high.

    Each task passes on its own first ones only."""
    kind, doc_kind = dict(queries.dtypes)[query], dict(docs.dtypes)[doc]
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(vec).alias("vec")).where("vec IS NOT NULL AND doc_id IS NOT NULL")
    parts = []
    for part in _blocks(queries.select(query, vec).where(F.col(vec).isNotNull() & F.col(query).isNotNull()), query, block):
        ids, matrix = _collected(part)
        if ids:
            shared = docs.sparkSession.sparkContext.broadcast((ids, matrix))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                ids, matrix = shared.value
                held: list[list[tuple]] = [[] for _ in ids]
                for batch in batches:
                    if batch.num_rows:
                        own = batch.column(0).to_pylist()
                        s = rounded(matrix @ _matrix(batch.column(1)).T, digits)
                        for i, j in zip(*np.nonzero((s >= low) & (s < high)), strict=True):
                            if own[j] != ids[i]:
                                held[i].append((own[j], float(s[i, j])))
                        held = [sorted(h)[:first] for h in held]
                rows = [(q, d, s) for q, h in zip(ids, held, strict=True) for d, s in h]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=["query_id", "doc_id", "score"])

            parts.append(rows.mapInArrow(run, f"query_id {kind}, doc_id {doc_kind}, score double"))
    if not parts:
        return docs.sparkSession.createDataFrame([], f"query_id {kind}, doc_id {doc_kind}, score double, place int")
    together = reduce(DataFrame.unionByName, parts)
    return together.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).where(F.col("place") <= first)


def _against(docs: DataFrame, bank: DataFrame, vec: str, columns: dict[str, str], per_block: Callable, apart: tuple[str, str] | None = None) -> DataFrame:
    """docs with columns worked out from their similarities to one block of the bank.

    apart: columns of docs and of the bank; the similarity of rows where they are equal counts as minus infinity."""
    rows = bank.select(F.col(apart[1]) if apart else F.lit(0), vec).where(F.col(vec).isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(_collected(rows))
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in docs.columns) + "".join(f", {c} {t}" for c, t in columns.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            if batch.num_rows:
                sims = _matrix(batch.column(batch.schema.get_field_index(vec))) @ matrix.T
                if apart:
                    sims[batch.column(batch.schema.get_field_index(apart[0])).to_numpy(zero_copy_only=False)[:, None] == np.array(ids)] = -np.inf
                new = per_block(sims)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for x in new]], names=[*batch.schema.names, *columns])

    return docs.where(F.col(vec).isNotNull()).mapInArrow(run, schema)


def clean_bank(bank: DataFrame, fitted: DataFrame, key: str = "query_id") -> DataFrame:
    """The bank without the statements that something is fitted on."""
    return bank.join(fitted.select(key).distinct(), key, "left_anti")


def _banks(bank: DataFrame, vec: str, block: int) -> list[DataFrame]:
    """The bank in blocks that aren't empty; equal vectors are spread too."""
    rows = bank.select(vec).where(F.col(vec).isNotNull())
    n = rows.count()
    if n <= block:
        return [rows]
    numbered = rows.sparkSession.createDataFrame(rows.rdd.zipWithIndex().map(lambda r: (r[1], r[0][0])), f"place bigint, `{vec}` {dict(rows.dtypes)[vec]}")
    return [numbered.where((F.col("place") >= at) & (F.col("place") < at + block)).select(vec) for at in range(0, n, block)]


def _with_largest(docs: DataFrame, bank: DataFrame, k: int, vec: str, block: int) -> DataFrame:
    """docs with _best, each document's k largest similarities to the bank (all, if the bank is smaller), largest first.

    Of a bank of many blocks a document carries them from one to the next."""

    def largest(sims: np.ndarray) -> list:
        n = max(1, min(k, sims.shape[1]))
        return [list(-np.sort(np.partition(-sims, n - 1, axis=1)[:, :n], axis=1))]

    parts = _banks(bank, vec, block)
    out = _against(docs, parts[0], vec, {"_best": "array<double>"}, largest)
    for part in parts[1:]:
        out = _against(out, part, vec, {"_more": "array<double>"}, largest)
        out = out.withColumn("_best", F.slice(F.sort_array(F.concat("_best", "_more"), asc=False), 1, max(1, k))).drop("_more")
    return out


def with_hubs(docs: DataFrame, bank: DataFrame, k: int | tuple[int, ...] = 3, vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """docs with hub, the mean of each document's k largest similarities to the bank; of several k: hub_1, hub_3, ..."""
    sizes = {"hub": k} if isinstance(k, int) else {f"hub_{n}": n for n in k}
    out = _with_largest(docs, bank, max(1, *sizes.values()), vec, block)
    mean = lambda n: F.aggregate(F.slice("_best", 1, max(1, n)), F.lit(0.0), lambda s, x: s + x) / F.least(F.size("_best"), F.lit(max(1, n)))
    return out.withColumns({name: mean(n) for name, n in sizes.items()}).drop("_best")


def with_log_mass(docs: DataFrame, bank: DataFrame, temperature: float = 50.0, vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """docs with log_mass, the logarithm of the sum of exp(temperature * similarity) over the bank."""
    parts = _banks(bank, vec, block)

    def mass(sims: np.ndarray) -> list[np.ndarray]:
        x = temperature * sims
        top = x.max(axis=1)
        return [top + np.log(np.exp(x - top[:, None]).sum(axis=1))]

    out = _against(docs, parts[0], vec, {"log_mass": "double"}, mass)
    for part in parts[1:]:
        out = _against(out, part, vec, {"_more": "double"}, mass)
        high, low = F.greatest("log_mass", "_more"), F.least("log_mass", "_more")
        out = out.withColumn("log_mass", high + F.log1p(F.exp(low - high))).drop("_more")
    return out


def best_similarity(docs: DataFrame, queries: DataFrame, digits: int = 12, block: int = BLOCK, apart: bool = False) -> DataFrame:
    """(doc_id, best): each document's largest similarity to any query (apart: of another id)."""
    rows, parts = docs.select("doc_id", "vec"), []
    for part in _blocks(queries.select("query_id", "vec"), "query_id", block):
        if part.limit(1).count():
            parts.append(_against(rows, part, "vec", {"best": "double"}, lambda sims: [rounded(sims, digits).max(axis=1)], ("doc_id", "query_id") if apart else None).select("doc_id", "best"))
    if not parts:
        return rows.select("doc_id", F.lit(None).cast("double").alias("best")).limit(0)
    return reduce(DataFrame.unionByName, parts).where(F.col("best") > float("-inf")).groupBy("doc_id").agg(F.max("best").alias("best"))


def inverted_softmax(queries: DataFrame, docs: DataFrame, bank: DataFrame, k: int, temperature: float = 50.0, apart: bool = False) -> DataFrame:
    """The k best documents of each query by similarity, with `log_score`: for documents that are the best of some
    query, the log of the dynamic inverted softmax, brought to the largest raw similarity among them; for others the log
    of the raw similarity (null where it isn't positive)."""
    found = topk(queries, docs, k, digits=12, apart=apart)
    hubs = found.where("rank = 1").select("doc_id").distinct()
    massed = with_log_mass(docs.join(hubs, "doc_id", "left_semi"), bank, temperature).select("doc_id", "log_mass")
    # only documents that lead some query are normalised, so the scale is taken over all queries' pairs with them
    # and for one document the largest similarity gives the largest value, so one row a document and block is enough
    best = best_similarity(docs.join(hubs, "doc_id", "left_semi"), queries, apart=apart).join(massed, "doc_id")
    scale = best.agg(F.max("best").alias("top"), F.max(F.col("best") * temperature - F.col("log_mass")).alias("mass"))
    joined = found.join(massed, "doc_id", "left").crossJoin(F.broadcast(scale))
    log = F.when(F.col("log_mass").isNotNull(), F.col("score") * temperature - F.col("log_mass") + F.log("top") - F.col("mass")).when(F.col("score") > 0, F.log("score"))
    return joined.select("query_id", "doc_id", F.round("score", DIGITS).alias("score"), "rank", F.round(log, DIGITS).alias("log_score"))


def cosine(a: str, b: str):  # noqa: ANN201
    """Cosine of two vector columns, 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)
