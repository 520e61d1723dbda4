"""Queries over `embeddings`: the rows of ids divisible by 100 ask, all rows are searched (a query's own row apart), the
rows of remainder 1 by ten are the bank; relevant is what has the same label.

The tables hold no programs, so verdicts are stubs made from labels: two examples (none for ids divisible by 300), and
a candidate of the query's label passes one or two of them. The operators take them as given. Relevance is told by
comparing labels, and relevant documents are counted by label, so pairs of queries and relevant documents never exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import dense, metrics, mining, rerank
from tarn.plans.registry import query, table

POOL, BASE, EXTEND, ALPHA, TAU, BETA, HUB_K = 100, 20, 60, 3.0, 0.02, 0.75, 3


def _roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")
    return e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e.where("vec_id % 10 = 1"), e.withColumnRenamed("vec_id", "doc_id")


def _demoted(spark: SparkSession, sf_dir: str, k: int = POOL, beta: float = BETA, hub_k: int = HUB_K) -> DataFrame:
    q, bank, docs = _roles(spark, sf_dir)
    hubs = dense.with_hubs(docs, bank, hub_k).withColumn("minus", F.col("hub") * beta)
    return dense.topk(q, hubs, k, minus="minus", apart=True)


def _labelled(pairs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs with the query's label ql and the document's label."""
    q, _, docs = _roles(spark, sf_dir)
    return pairs.join(q.select("query_id", F.col("label").alias("ql")), "query_id").join(docs.select("doc_id", "label"), "doc_id")


def _hits(ranked: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(ranked, spark, sf_dir).where("label = ql")


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, n_rel): how many others have the query's label."""
    q, _, docs = _roles(spark, sf_dir)
    return q.select("query_id", "label").join(docs.groupBy("label").agg((F.count("*") - 1).alias("n_rel")), "label").select("query_id", "n_rel")


def _scores(ranked: DataFrame, spark: SparkSession, sf_dir: str, cuts: tuple[int, ...] = metrics.CUTS, by: tuple[str, ...] = (), lists: DataFrame | None = None, some: str = "true") -> DataFrame:
    return metrics.of_hits(_hits(ranked, spark, sf_dir).where(some), _totals(spark, sf_dir).where(some), cuts, by, lists)


def _stub(candidates: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(candidates.select("query_id", "doc_id"), spark, sf_dir)
    some = F.col("query_id") % 300 != 0
    passed = F.when(some & (F.col("label") == F.col("ql")), 1 + F.col("doc_id") % 2).otherwise(0)
    return rows.select("query_id", "doc_id", passed.cast("int").alias("passed"), F.when(some, 2).otherwise(0).alias("total"))


_SQL = f"""
WITH q AS (SELECT vec_id AS query_id, label AS ql, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0),
b AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 10 = 1),
d AS (SELECT vec_id AS doc_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT query_id, ql, doc_id, label, list_inner_product(q.e, d.e) AS raw FROM q JOIN d ON query_id <> doc_id),
hub AS (SELECT doc_id, avg(x) AS hub FROM (SELECT doc_id, list_inner_product(d.e, b.e) AS x FROM d, b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY x DESC) <= {HUB_K}) GROUP BY doc_id),
plain AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, ql, doc_id, label, round(raw, 5) AS score FROM s)),
dem AS (SELECT query_id, ql, doc_id, label, round(raw - CAST({BETA} AS DOUBLE) * hub, 5) AS score FROM s JOIN hub USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dem),
margin AS (SELECT query_id, round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 5) AS margin FROM ranked WHERE rank <= 2 GROUP BY query_id),
cand AS (SELECT r.*, coalesce(margin < CAST({TAU} AS DOUBLE), false) AS uncertain FROM ranked r JOIN margin USING (query_id) WHERE rank <= {BASE} OR (margin < CAST({TAU} AS DOUBLE) AND rank <= {EXTEND})),
verdict AS (SELECT query_id, doc_id, uncertain, rank, CASE WHEN label = ql AND query_id % 300 <> 0 THEN 1 + doc_id % 2 ELSE 0 END AS passed FROM cand),
m AS (SELECT query_id, count(*) FILTER (passed > 0) AS m, count(*) FILTER (passed = 2) AS n_all_pass FROM verdict GROUP BY query_id),
conf AS (SELECT v.*, m, n_all_pass, CASE WHEN passed > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, passed::DOUBLE / 2 / (1 + log2(greatest(1, m)::DOUBLE)))) ELSE 0.0::DOUBLE END AS conf FROM verdict v JOIN m USING (query_id)),
pool AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM ranked WHERE rank <= {POOL}),
normed AS (SELECT *, CASE WHEN hi - lo < 1e-9 THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END AS norm FROM pool),
qrels AS (SELECT query_id, doc_id FROM q JOIN d ON ql = label AND query_id <> doc_id)
"""


@query(_SQL + "SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM plain WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar documents of each query."""
    q, _, docs = _roles(spark, sf_dir)
    return dense.topk(q, docs, 10, apart=True)


@query("""
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST([CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END for i in range(len(embedding))] AS DOUBLE[])), 5) AS cosine FROM embeddings
""")
def general_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with one that isn't normalised."""
    other = F.transform("embedding", lambda x, i: F.when(i % 2 == 0, 1.0).otherwise(-1.0))
    return table(spark, sf_dir, "embeddings").withColumn("other", other).select("vec_id", F.round(dense.cosine("embedding", "other"), 5).alias("cosine"))


@query("SELECT count(*) AS n FROM embeddings WHERE vec_id % 10 < 2 AND vec_id % 100 <> 0")
def bank_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank that holds the queries, without them."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"))
    return dense.clean_bank(e.where("query_id % 10 < 2"), e.where("query_id % 100 = 0")).agg(F.count("*").alias("n"))


@query(_SQL + "SELECT doc_id, round(hub, 5) AS hub FROM hub")
def qbnorm_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bank, docs = _roles(spark, sf_dir)
    return dense.with_hubs(docs, bank, HUB_K).select("doc_id", F.round("hub", 5).alias("hub"))


@query(_SQL + "SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10")
def qbnorm_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demoted(spark, sf_dir, 10)


@query(_SQL + """, top1 AS (SELECT DISTINCT doc_id FROM plain12 WHERE rank = 1),
mass AS (SELECT doc_id, max(50 * x) + ln(sum(exp(50 * x - mx))) AS log_mass FROM (SELECT doc_id, list_inner_product(d.e, b.e) AS x, max(50 * list_inner_product(d.e, b.e)) OVER (PARTITION BY doc_id) AS mx FROM d, b WHERE doc_id IN (SELECT doc_id FROM top1)) GROUP BY doc_id),
pairs AS (SELECT p.*, log_mass FROM plain12 p JOIN mass USING (doc_id)),
scale AS (SELECT max(score) AS top, max(50 * score - log_mass) AS mass FROM pairs)
SELECT query_id, p.doc_id, round(score, 5) AS score, CAST(rank AS INT) AS rank,
  round(CASE WHEN log_mass IS NOT NULL THEN 50 * score - log_mass + ln(top) - mass WHEN score > 0 THEN ln(score) END, 5) AS log_score
FROM plain12 p LEFT JOIN mass USING (doc_id), scale WHERE rank <= 10
""".replace(", top1 AS", ", plain12 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(raw, 12) AS score FROM s)), top1 AS"))
def dis_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamic inverted softmax, in logarithms: its raw values span too many orders of magnitude."""
    q, bank, docs = _roles(spark, sf_dir)
    return dense.inverted_softmax(q, docs, bank, 10, apart=True)


@query(_SQL + "SELECT query_id, margin, coalesce(margin < CAST(0.02 AS DOUBLE), false) AS extend FROM margin")
def router_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rerank.margins(_demoted(spark, sf_dir, 2))
    return m.withColumn("extend", F.coalesce(F.col("margin") < TAU, F.lit(False)))


@query(_SQL + "SELECT query_id, doc_id, round(norm, 5) AS norm FROM normed")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.min_max(_demoted(spark, sf_dir)).select("query_id", "doc_id", F.round("norm", 5).alias("norm"))


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pool = _demoted(spark, sf_dir)  # margins, candidates and the pool's range all come from its one exchange
    return pool, rerank.gated(pool, rerank.margins(pool), TAU, BASE, EXTEND)


@query(_SQL + "SELECT query_id, doc_id, CAST(rank AS INT) AS rank, uncertain FROM cand")
def gated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)[1].select("query_id", "doc_id", "rank", "uncertain")


@query(_SQL + f"SELECT (SELECT count(*) FROM q) AS queries, count(DISTINCT CASE WHEN uncertain THEN query_id END) AS extended, count(*) FILTER (rank > {BASE}) AS extra FROM cand")
def router_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.router_counters(_candidates(spark, sf_dir)[1], _roles(spark, sf_dir)[0], BASE)


@query(_SQL + "SELECT query_id, doc_id, m, n_all_pass, round(conf, 5) AS conf FROM conf")
def rarity_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rerank.with_confidence(_stub(_candidates(spark, sf_dir)[1], spark, sf_dir))
    return v.select("query_id", "doc_id", "m", "n_all_pass", F.round("conf", 5).alias("conf"))


@query(_SQL + """, r AS (SELECT * FROM verdict WHERE rank <= 10), rm AS (SELECT query_id, count(*) FILTER (passed > 0) AS m FROM r GROUP BY query_id)
SELECT query_id, doc_id, m, round(CASE WHEN passed > 0 THEN passed::DOUBLE / 2 / (1 + log2(greatest(1, m)::DOUBLE)) ELSE 0.0::DOUBLE END, 5) AS conf FROM r JOIN rm USING (query_id)""")
def restricted_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the first ten candidates only, with the confidence of that subset."""
    c = _candidates(spark, sf_dir)[1]
    return rerank.restricted(rerank.with_confidence(_stub(c, spark, sf_dir)), c.where("rank <= 10")).select("query_id", "doc_id", "m", F.round("conf", 5).alias("conf"))


_BLEND = """SELECT query_id, doc_id, final, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, rank) AS INT) AS final_rank FROM
  (SELECT n.query_id, n.doc_id, n.rank, round(norm + CAST(3.0 AS DOUBLE) * {conf}, 5) AS final FROM normed n LEFT JOIN conf c ON n.query_id = c.query_id AND n.doc_id = c.doc_id)"""


@query(_SQL + f"SELECT * FROM ({_BLEND.format(conf='CASE WHEN n.rank <= 20 THEN coalesce(conf, 0) ELSE 0 END')})")
def blend_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence counts for the first twenty only."""
    pool, c = _candidates(spark, sf_dir)
    out = rerank.blend(pool, rerank.with_confidence(_stub(c, spark, sf_dir)), ALPHA, depth=BASE)
    return out.select("query_id", "doc_id", "final", "final_rank")


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, c = _candidates(spark, sf_dir)
    return rerank.blend(pool, rerank.with_confidence(_stub(c, spark, sf_dir)), ALPHA)


@query(_SQL + f"SELECT * FROM ({_BLEND.format(conf='coalesce(conf, 0)')}) WHERE final_rank <= 10")
def gated_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: demoted similarity, candidates by margin, confidence, blend; ten best."""
    return _gated(spark, sf_dir).where("final_rank <= 10").select("query_id", "doc_id", "final", "final_rank")


_METRICS = """, cuts(k) AS (VALUES (1), (3), (5), (10), (20), (100), (1000)), rel AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY query_id),
hits AS (SELECT {by} r.query_id, r.rank, row_number() OVER (PARTITION BY {by} r.query_id ORDER BY r.rank) AS i FROM {ranked} r JOIN qrels USING (query_id, doc_id)),
ideal AS (SELECT n AS n, sum(1.0::DOUBLE / log2(i + 1.0::DOUBLE)) AS ideal FROM (SELECT DISTINCT least(k, n_rel) AS n FROM cuts, rel), unnest(range(1, n + 1)) AS u(i) GROUP BY n),
each AS (SELECT {gby} c.k, rel.query_id, coalesce(sum(1.0::DOUBLE / log2(rank + 1.0::DOUBLE)), 0) / any_value(ideal) AS ndcg, coalesce(1.0::DOUBLE / min(rank), 0) AS mrr,
  count(rank)::DOUBLE / any_value(n_rel) AS recall, coalesce(sum(i::DOUBLE / rank), 0) / least(c.k, any_value(n_rel)) AS map
  FROM rel CROSS JOIN cuts c {grid} JOIN ideal ON ideal.n = least(c.k, n_rel) LEFT JOIN hits ON hits.query_id = rel.query_id AND hits.rank <= c.k {on} GROUP BY {gby} c.k, rel.query_id)
"""


@query(_SQL + _METRICS.format(by="", gby="", grid="", on="", ranked="(SELECT * FROM ranked WHERE rank <= 100)") + "SELECT k, round(avg(ndcg), 5) AS ndcg, round(avg(mrr), 5) AS mrr, round(avg(recall), 5) AS recall, round(avg(map), 5) AS map FROM each GROUP BY k")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_demoted(spark, sf_dir), spark, sf_dir)


@query(_SQL + "SELECT query_id, CAST(coalesce(min(rank), 0) AS INT) AS gold_rank FROM qrels LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r USING (query_id, doc_id) GROUP BY query_id")
def rank_of_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.first_hits(_hits(_demoted(spark, sf_dir, 10), spark, sf_dir), _totals(spark, sf_dir).where("n_rel > 0").select("query_id"))


# --- sweeps -----------------------------------------------------------------------------------------------------------

# The settings of the sweeps.
ALPHAS = (0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.50, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)
TAUS = (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 1.0)
HUB_KS, BETAS = (1, 3, 5), (0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0)
CUT = 10


def _grid(spark: SparkSession, name: str, values: tuple) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(v,) for v in values], f"{name} double"))


def _ordered(rows: DataFrame, by: list[str], final: Column) -> DataFrame:
    """rows with rank, by final (rounded) and the rank they had."""
    order = rerank.Window.partitionBy(*by, "query_id").orderBy(F.desc("final"), "rank")
    return rows.withColumn("final", F.round(final, 5)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CUT)


def _ndcg(ranked: DataFrame, by: tuple[str, ...], lists: DataFrame, name: str, spark: SparkSession, sf_dir: str, some: str = "true") -> DataFrame:
    return _scores(ranked, spark, sf_dir, (CUT,), by, lists, some).select(*by, F.col("ndcg").alias(name))


def _values(grid: tuple) -> str:
    return f"(SELECT CAST(x AS DOUBLE) FROM (VALUES {', '.join(f'({v})' for v in grid)}) AS v(x))"


def _ndcg_sql(name: str, ranked: str, grid: str, by: tuple[str, ...], some: str = "true") -> str:
    """A table of the sweep's settings and their ndcg over queries with a relevant document."""
    keys, same = ", ".join(f"g.{c}" for c in by), " AND ".join(f"r.{c} = g.{c}" for c in by)
    return f""", {name} AS (SELECT {", ".join(by)}, round(avg(coalesce(dcg, 0) / ideal), 5) AS ndcg FROM (
  SELECT {keys}, n.query_id, sum(CASE WHEN r.rank <= {CUT} THEN 1.0::DOUBLE / log2(r.rank + 1.0::DOUBLE) END) AS dcg,
    any_value(list_sum([1.0::DOUBLE / log2(i + 1.0::DOUBLE) for i in range(1, least({CUT}, n.n_rel) + 1)])) AS ideal
  FROM (SELECT query_id, count(*) AS n_rel FROM qrels WHERE {some} GROUP BY query_id) n CROSS JOIN {grid} g
  LEFT JOIN (SELECT r.* FROM {ranked} r JOIN qrels USING (query_id, doc_id) WHERE rank <= {CUT}) r ON r.query_id = n.query_id AND {same} GROUP BY {keys}, n.query_id) GROUP BY {", ".join(by)})
"""


def _alpha_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts don't depend on alpha, so they are worked out once and blended with each value of it."""
    pool, c = _candidates(spark, sf_dir)
    blended = rerank.blend(pool, rerank.with_confidence(_stub(c, spark, sf_dir)), 1.0)
    rows = blended.select("query_id", "doc_id", "rank", "norm", "conf").crossJoin(_grid(spark, "alpha", ALPHAS))
    return _ordered(rows, ["alpha"], F.col("norm") + F.col("alpha") * F.col("conf"))


_ALPHA = _SQL + f""", grid(alpha) AS {_values(ALPHAS)},
swept AS (SELECT alpha, query_id, doc_id, row_number() OVER (PARTITION BY alpha, query_id ORDER BY final DESC, rank) AS rank FROM
  (SELECT alpha, n.query_id, n.doc_id, n.rank, round(norm + alpha * coalesce(conf, 0), 5) AS final FROM normed n LEFT JOIN conf c ON n.query_id = c.query_id AND n.doc_id = c.doc_id, grid))
""" + _ndcg_sql("every_", "swept", "grid", ("alpha",)) + _ndcg_sql("partly", "swept", "grid", ("alpha",), "query_id % 300 <> 0")
#: Queries with examples, which alone have verdicts.
_WITH_EXAMPLES = "query_id % 300 <> 0"


@query(_ALPHA + "SELECT alpha, every_.ndcg, partly.ndcg AS ndcg_with_examples FROM every_ JOIN partly USING (alpha)")
def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alpha's score, over all queries and over those with examples."""
    lists, grid = _alpha_lists(spark, sf_dir), _grid(spark, "alpha", ALPHAS)
    return _ndcg(lists, ("alpha",), grid, "ndcg", spark, sf_dir).join(_ndcg(lists, ("alpha",), grid, "ndcg_with_examples", spark, sf_dir, _WITH_EXAMPLES), "alpha")


@query(_ALPHA + "SELECT (SELECT arg_max(alpha, ndcg * 1000 - alpha / 1000) FROM every_) AS best, (SELECT min(alpha) FROM every_ WHERE ndcg >= (SELECT max(ndcg) FROM every_) - 0.001) AS plateau")
def alpha_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best alpha (the smaller one of equals), and the smallest one nearly as good."""
    scores = _ndcg(_alpha_lists(spark, sf_dir), ("alpha",), _grid(spark, "alpha", ALPHAS), "ndcg", spark, sf_dir)
    return metrics.best_setting(scores, "alpha", "ndcg").select(F.col("alpha").alias("best")).crossJoin(metrics.plateau(scores, "alpha", "ndcg").withColumnRenamed("alpha", "plateau"))


_TAU = _SQL + f""", grid(tau) AS {_values(TAUS)},
c2 AS (SELECT tau, r.query_id, r.doc_id, CASE WHEN label = ql AND r.query_id % 300 <> 0 THEN 1 + doc_id % 2 ELSE 0 END AS passed FROM ranked r JOIN margin USING (query_id), grid WHERE rank <= {BASE} OR (margin < tau AND rank <= {EXTEND})),
m2 AS (SELECT tau, query_id, count(*) FILTER (passed > 0) AS m FROM c2 GROUP BY tau, query_id),
f2 AS (SELECT c2.*, CASE WHEN passed > 0 THEN passed::DOUBLE / 2 / (1 + log2(greatest(1, m)::DOUBLE)) ELSE 0.0::DOUBLE END AS conf FROM c2 JOIN m2 USING (tau, query_id)),
swept AS (SELECT tau, query_id, doc_id, row_number() OVER (PARTITION BY tau, query_id ORDER BY final DESC, rank) AS rank FROM
  (SELECT grid.tau, n.query_id, n.doc_id, n.rank, round(norm + CAST({ALPHA} AS DOUBLE) * coalesce(conf, 0), 5) AS final FROM normed n CROSS JOIN grid LEFT JOIN f2 ON n.query_id = f2.query_id AND n.doc_id = f2.doc_id AND f2.tau = grid.tau))
""" + _ndcg_sql("every_", "swept", "grid", ("tau",)) + """, x AS (SELECT tau, count(query_id) AS extended FROM grid LEFT JOIN margin ON margin < tau GROUP BY tau)
"""


def _tau_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the widest gate, restricted to each narrower one."""
    pool = _demoted(spark, sf_dir)
    grid, margin = _grid(spark, "tau", TAUS), rerank.margins(pool)
    uncertain = F.coalesce(F.col("margin") < F.col("tau"), F.lit(False))
    inside = pool.join(margin, "query_id", "left").crossJoin(grid).where((F.col("rank") <= BASE) | (uncertain & (F.col("rank") <= EXTEND)))
    judged = inside.join(_stub(pool.where(F.col("rank") <= EXTEND), spark, sf_dir), ["query_id", "doc_id"])
    judged = judged.withColumn("m", F.sum(F.when(F.col("passed") > 0, 1).otherwise(0)).over(rerank.Window.partitionBy("tau", "query_id")))
    conf = judged.select("tau", "query_id", "doc_id", rerank.rarity_confidence(F.col("passed"), F.col("total"), F.col("m")).alias("conf"))
    rows = rerank.min_max(pool).crossJoin(grid).join(conf, ["tau", "query_id", "doc_id"], "left")
    scores = _ndcg(_ordered(rows, ["tau"], F.col("norm") + ALPHA * F.coalesce("conf", F.lit(0.0))), ("tau",), grid, "ndcg", spark, sf_dir)
    extended = margin.crossJoin(grid).groupBy("tau").agg(F.count(F.when(F.col("margin") < F.col("tau"), 1)).alias("extended"))
    return scores.join(extended, "tau")


@query(_TAU + "SELECT tau, ndcg, extended FROM every_ JOIN x USING (tau)")
def tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tau_scores(spark, sf_dir)


@query(_TAU + """, t AS (SELECT *, row_number() OVER (ORDER BY ndcg DESC, extended, tau) AS place, max(CASE WHEN tau = 0 THEN ndcg END) OVER () AS base FROM every_ JOIN x USING (tau)),
g AS (SELECT query_id, coalesce(min(rank), 0) AS gold FROM qrels LEFT JOIN (SELECT * FROM ranked WHERE rank <= 100) r USING (query_id, doc_id) GROUP BY query_id)
SELECT tau, ndcg, extended, round(ndcg - base, 5) AS gain, CASE WHEN round(ndcg - base, 5) > 0 AND tau > 0 THEN 'ADOPT' ELSE 'REJECT' END AS decision,
  (SELECT count(*) FROM g WHERE gold = 0 OR gold > 20) AS gold_beyond_base, (SELECT count(*) FROM g WHERE gold > 20 AND gold <= 60) AS gold_within_extend FROM t WHERE place = 1""")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tau (of equals the one that extends fewer queries), whether it is adopted, and where relevant documents
    stand. Nothing is extended at tau 0, which is the base."""
    scores = _tau_scores(spark, sf_dir)
    base = scores.where("tau = 0").select(F.col("ndcg").alias("base"))
    best = metrics.adopted(scores.crossJoin(F.broadcast(base)), "tau", "ndcg", F.col("base"), "extended").drop("base")
    gold = metrics.first_hits(_hits(_demoted(spark, sf_dir), spark, sf_dir), _totals(spark, sf_dir).where("n_rel > 0").select("query_id"))
    g = F.col("gold_rank")
    stands = gold.agg(F.count(F.when((g == 0) | (g > BASE), 1)).alias("gold_beyond_base"), F.count(F.when((g > BASE) & (g <= EXTEND), 1)).alias("gold_within_extend"))
    return best.crossJoin(stands)


def _beta_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of demotion by (k, beta), of the demoted lists and of those blended with verdicts; one search does them all.

    Verdicts are those of the first candidates without demotion."""
    q, bank, docs = _roles(spark, sf_dir)
    hubs = dense.with_hubs(docs, bank, HUB_KS)
    settings = [(k, beta) for k in HUB_KS for beta in BETAS]
    pool = dense.topk_each(q, hubs, POOL, [F.col(f"hub_{k}") * beta for k, beta in settings], apart=True)
    grid = F.broadcast(spark.createDataFrame([(n, *s) for n, s in enumerate(settings)], "setting int, hub_k int, beta double"))
    conf = rerank.with_confidence(_stub(pool.where((F.col("setting") == 0) & (F.col("rank") <= BASE)), spark, sf_dir)).select("query_id", "doc_id", "conf")
    each = rerank.Window.partitionBy("setting", "query_id")
    low, high = F.min("score").over(each), F.max("score").over(each)
    rows = pool.withColumn("norm", F.when(high - low < 1e-9, 1.0).otherwise((F.col("score") - low) / (high - low))).join(conf, ["query_id", "doc_id"], "left")
    blended = _ordered(rows, ["setting"], F.col("norm") + ALPHA * F.coalesce("conf", F.lit(0.0)))
    names = grid.select("setting")
    scores = _ndcg(pool.where(F.col("rank") <= CUT), ("setting",), names, "ndcg_dense", spark, sf_dir).join(_ndcg(blended, ("setting",), names, "ndcg", spark, sf_dir), "setting")
    return scores.join(grid, "setting")


def _hub_sql(k: int) -> str:
    return f"SELECT {k} AS hub_k, doc_id, avg(x) AS hub FROM (SELECT doc_id, list_inner_product(d.e, b.e) AS x FROM d, b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY x DESC) <= {k}) GROUP BY doc_id"


_BETA = _SQL + f""", hubs AS ({" UNION ALL ".join(_hub_sql(k) for k in HUB_KS)}), grid AS (SELECT * FROM (SELECT DISTINCT hub_k FROM hubs), {_values(BETAS)} AS b(beta)),
lists AS (SELECT * FROM (SELECT hub_k, beta, query_id, ql, doc_id, label, score, row_number() OVER (PARTITION BY hub_k, beta, query_id ORDER BY score DESC, doc_id) AS rank FROM
  (SELECT grid.hub_k, beta, query_id, ql, doc_id, label, round(raw - beta * hub, 5) AS score FROM s JOIN hubs USING (doc_id) JOIN grid ON grid.hub_k = hubs.hub_k)) WHERE rank <= {POOL}),
v3 AS (SELECT query_id, doc_id, CASE WHEN label = ql AND query_id % 300 <> 0 THEN 1 + doc_id % 2 ELSE 0 END AS passed FROM plain WHERE rank <= {BASE}),
m3 AS (SELECT query_id, count(*) FILTER (passed > 0) AS m FROM v3 GROUP BY query_id),
f3 AS (SELECT query_id, doc_id, CASE WHEN passed > 0 THEN passed::DOUBLE / 2 / (1 + log2(greatest(1, m)::DOUBLE)) ELSE 0.0::DOUBLE END AS conf FROM v3 JOIN m3 USING (query_id)),
n3 AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM lists WINDOW w AS (PARTITION BY hub_k, beta, query_id)),
swept AS (SELECT hub_k, beta, query_id, doc_id, row_number() OVER (PARTITION BY hub_k, beta, query_id ORDER BY final DESC, rank) AS rank FROM
  (SELECT n3.*, round(CASE WHEN hi - lo < 1e-9 THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END + CAST({ALPHA} AS DOUBLE) * coalesce(conf, 0), 5) AS final FROM n3 LEFT JOIN f3 ON n3.query_id = f3.query_id AND n3.doc_id = f3.doc_id))
""" + _ndcg_sql("dense", "lists", "grid", ("hub_k", "beta")) + _ndcg_sql("every_", "swept", "grid", ("hub_k", "beta"))


@query(_BETA + "SELECT CAST(hub_k AS INT) AS hub_k, beta, dense.ndcg AS ndcg_dense, every_.ndcg FROM dense JOIN every_ USING (hub_k, beta)")
def beta_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demotion by (k, beta); beta 0 is no demotion."""
    return _beta_scores(spark, sf_dir).select("hub_k", "beta", "ndcg_dense", "ndcg")


@query(_BETA + """SELECT CAST(hub_k AS INT) AS hub_k, beta, ndcg, round(ndcg - base, 5) AS gain, CASE WHEN round(ndcg - base, 5) > 0 AND beta > 0 THEN 'ADOPT' ELSE 'REJECT' END AS decision FROM
  (SELECT *, row_number() OVER (ORDER BY ndcg DESC, (beta > 0)::INT, hub_k, beta) AS place, max(CASE WHEN beta = 0 THEN ndcg END) OVER () AS base FROM every_) WHERE place = 1""")
def beta_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best (k, beta), of equals one without demotion and else the first of the grid, and whether it is adopted."""
    scores = _beta_scores(spark, sf_dir)
    base = scores.agg(F.max(F.when(F.col("beta") == 0, F.col("ndcg"))).alias("base"))
    order = F.when(F.col("beta") > 0, 1 + F.col("setting")).otherwise(0)
    best = metrics.adopted(scores.withColumn("order", order).crossJoin(F.broadcast(base)), "beta", "ndcg", F.col("base"), "order")
    return best.select("hub_k", "beta", "ndcg", "gain", "decision")


# --- mining -----------------------------------------------------------------------------------------------------------


def _negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _, docs = _roles(spark, sf_dir)
    return mining.first_negatives(_labelled(dense.topk(q, docs, 100, apart=True), spark, sf_dir).where("label <> ql"), 15).select("query_id", "doc_id", "rank", "place")


_NEGATIVES = _SQL + ", neg AS (SELECT * FROM (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM plain WHERE rank <= 100 AND label <> ql) WHERE place <= 15)"


@query(_NEGATIVES + " SELECT query_id, doc_id, CAST(rank AS INT) AS rank, CAST(place AS INT) AS place FROM neg")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _negatives(spark, sf_dir)


_NEAR = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.e, b.e), 5) AS score FROM e a, e b WHERE a.vec_id % 100 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS place FROM p WHERE query_id <> doc_id AND score >= 0.3 AND score < 0.999) WHERE place <= 5)
"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _, docs = _roles(spark, sf_dir)
    return dense.neighbours(q, docs, 0.3, 0.999, 5)


@query(_NEAR + "SELECT query_id, doc_id, score, CAST(place AS INT) AS place FROM near")
def cluster_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in a band of similarity, the first five by id (the band is lower than by default: vectors here are
    farther apart)."""
    return _near(spark, sf_dir).select("query_id", "doc_id", "score", "place")


@query(_NEGATIVES + """, near AS (SELECT * FROM (SELECT query_id, doc_id AS other, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS place FROM s WHERE round(raw, 5) >= 0.3 AND round(raw, 5) < 0.999) WHERE place <= 5),
gold AS (SELECT vec_id AS query_id, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS doc_id FROM embeddings),
theirs AS (SELECT near.query_id, gold.doc_id, min(place) AS near FROM near JOIN gold ON near.other = gold.query_id GROUP BY ALL),
new AS (SELECT * FROM theirs t WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.query_id = t.query_id AND g.doc_id = t.doc_id) AND NOT EXISTS (SELECT 1 FROM neg n WHERE n.query_id = t.query_id AND n.doc_id = t.doc_id))
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o, doc_id) AS INT) AS place FROM (SELECT query_id, doc_id, -near AS o FROM new UNION ALL SELECT query_id, doc_id, place FROM neg)""")
def neighbours_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant documents of the neighbours in front of the mined negatives; one document by a rule stands for each row's
    relevant one."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    gold = e.select("vec_id").crossJoin(F.broadcast(n)).select(F.col("vec_id").alias("query_id"), ((F.col("vec_id") * 7 + 3) % F.col("n")).alias("doc_id"))
    near = _near(spark, sf_dir).select("query_id", F.col("doc_id").alias("other"), "place")
    return mining.with_neighbours_golds(_negatives(spark, sf_dir), near, gold)


@query(_NEGATIVES + """, few AS (SELECT query_id, list(doc_id ORDER BY place) AS n FROM neg WHERE place <= 5 GROUP BY query_id),
h AS (SELECT query_id, doc_id, n, substr(sha256('7:' || query_id || ':' || doc_id), 1, 3) AS h FROM plain JOIN few USING (query_id) WHERE rank <= 100 AND label = ql)
SELECT query_id, doc_id AS positive, n[1 + (list_sum([(strpos('0123456789abcdef', substr(h, i, 1)) - 1) * CASE i WHEN 1 THEN 256 WHEN 2 THEN 16 ELSE 1 END for i in [1, 2, 3]]) % len(n))::INT] AS negative FROM h""")
def training_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant documents among the hundred nearest with a hard negative each, chosen by a hash."""
    q, _, docs = _roles(spark, sf_dir)
    return mining.triples(_hits(dense.topk(q, docs, 100, apart=True), spark, sf_dir).select("query_id", "doc_id"), _negatives(spark, sf_dir))


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, vec_id % 7 AS path FROM embeddings), q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0),
n AS (SELECT path, max(vec_id) AS vec_id FROM v GROUP BY path), o AS (SELECT path, max(vec_id) AS vec_id FROM v WHERE vec_id < 250 GROUP BY path),
na AS (SELECT name, list(path ORDER BY r) AS paths FROM (SELECT q.vec_id AS name, n.path, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.e, v.e), 5) DESC, n.path) AS r FROM q, n JOIN v USING (vec_id)) WHERE r <= 5 GROUP BY name),
oa AS (SELECT name, list(path ORDER BY r) AS paths FROM (SELECT q.vec_id AS name, o.path, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.e, v.e), 5) DESC, o.path) AS r FROM q, o JOIN v USING (vec_id)) WHERE r <= 5 GROUP BY name)
SELECT name, array_to_string(na.paths, ',') AS paths, coalesce(oa.paths <> na.paths, false) AS changed FROM na LEFT JOIN oa USING (name)
""")
def standing_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing questions over a store before and after an ingest: a vector stands for a version, its id for the snapshot."""
    from tarn.streaming import standing

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    entries = e.select((F.col("vec_id") % 7).alias("path"), F.col("vec_id").alias("snapshot_index"), F.col("vec_id").cast("string").alias("sid"))
    vectors = e.select(F.col("vec_id").cast("string").alias("sid"), "vec")
    asked = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "name")
    before = standing.answers(asked, entries.where("snapshot_index < 250"), vectors)
    out = standing.changes(standing.answers(asked, entries, vectors), before)
    return out.select("name", F.array_join(F.transform("paths", lambda p: p.cast("string")), ",").alias("paths"), "changed")
