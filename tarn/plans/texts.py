"""Queries over texts, tables and snapshots: preprocessing, TF-IDF, joins, and the version store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text
from tarn.operators import metrics, mining, sparse, store
from tarn.plans.registry import query, table
from tarn.sources.tables import judged_queries, judgments

_NORM = r"""substr(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), 1, {n})"""


@query(f"SELECT doc_id, sha256({_NORM.format(c='text', n=32000)}) AS sha, length({_NORM.format(c='text', n=32000)}) AS n FROM documents")
def preprocess_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query normalisation, with its cut at 32,000 characters as a feature of the operator."""
    t = text.normalise_query(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("sha"), F.length(t).cast("long").alias("n"))


@query(f"SELECT page_id, sha256({_NORM.format(c='html', n=32000)}) AS sha FROM pages")
def preprocess_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.normalise_query(F.col("html")), 256).alias("sha"))


_EX = "VALUES (1, repeat('word ', 30) || chr(10) || 'Examples' || chr(10) || '1 2'), (2, 'short' || chr(10) || 'Example' || chr(10) || '1'), (3, repeat('x', 120) || chr(10) || 'Sample Input' || chr(10) || '5'), (4, 'no heading'), (5, NULL)"


@query(f"WITH s(id, t) AS ({_EX}), h AS (SELECT id, regexp_replace(coalesce(t, ''), '^\\s+|\\s+$', '', 'g') AS t FROM s) SELECT id, CASE WHEN length(string_split_regex(t, '(?i)\\n(?:examples?|sample input)')[1]) > 100 THEN regexp_replace(string_split_regex(t, '(?i)\\n(?:examples?|sample input)')[1], '[ \\t]+', ' ', 'g') ELSE regexp_replace(t, '[ \\t]+', ' ', 'g') END AS t FROM h")
def drop_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures: the part before an example heading, if it is long enough."""
    return spark.sql(_EX.replace("VALUES", "SELECT * FROM VALUES").replace("chr(10)", "'\\n'") + " AS s(id, t)").select("id", text.normalise_query(F.col("t"), without_examples=True).alias("t"))


_CODE = [
    (1, "import sys\ninput = sys.stdin.readline\n\n\n\nn = int(input())\nprint(n)\n"), (2, "from sys import stdin, stdout\nMOD = 10**9 + 7\nINF = float('inf')\nx = 1"),
    (3, "# author: nobody\nsys.setrecursionlimit(10**6)\nthreading.stack_size(2**27)\nprint = stdout.write\ny = 2"), (4, "   \n"), (5, "INF = 1000000000\nMOD = 998244353\n#---- my Template ----\nz = INF"), (6, "# useful remark\nw = 3"),
]


def _rows(rows: list[tuple]) -> str:
    """SQL rows of a fixture; line feeds as chr(10)."""
    lit = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def _stripped_sql(column: str) -> str:
    out = column
    for p in text.BOILERPLATE:
        out = f"regexp_replace({out}, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return f"regexp_replace(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"WITH s(id, code) AS ({_rows(_CODE)}) SELECT id, {_stripped_sql('code')} AS code FROM s")
def strip_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures: contest programs without their boilerplate."""
    return spark.createDataFrame(_CODE, "id int, code string").select("id", text.strip_boilerplate(F.col("code")).alias("code"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)\b(in any order|any order|any valid|any of them|print any)\b') AS any_order FROM documents")
def any_order_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.allows_any_order(F.col("text")).alias("any_order"))


_NUMBERS = [(1, "n up to 1000, answer modulo 998244353, at most 45 steps"), (2, "just 1 and 2"), (3, "v1.5 and x7, -7 -7 3.25 12"), (4, None)]


@query("SELECT * FROM (VALUES (1, '1000,45,998244353'), (2, ''), (3, '-7,12,3.25'), (4, '')) AS v(id, numbers)")
def statement_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures; the SQL holds expected rows, as its regular expressions have no lookaround."""
    return spark.createDataFrame(_NUMBERS, "id int, t string").select("id", F.array_join(text.statement_numbers(F.col("t")), ",").alias("numbers"))


_TERMS = r"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z_][A-Za-z0-9_]*|\d+|\S') AS w FROM documents
  UNION ALL SELECT 'q', item_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z_][A-Za-z0-9_]*|\d+|\S') FROM benchmark),
g AS (SELECT side, id, unnest(w) AS term FROM t UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] FROM t, unnest(range(1, greatest(len(w), 1))) AS u(i)),
c AS (SELECT side, id, term, count(*) AS tf FROM g GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM c WHERE side = 'd' GROUP BY term),
w AS (SELECT side, id, term, (1.0::DOUBLE + ln(tf)) * idf AS w FROM c JOIN idf USING (term)),
n AS (SELECT side, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS w FROM w)
"""


@query(_TERMS + "SELECT id AS doc_id, term, tf FROM c WHERE side = 'd'")
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query(_TERMS + "SELECT term, df, round(idf, 6) AS idf FROM idf")
def tfidf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sparse.inverse_frequencies(sparse.term_counts(docs, "doc_id", "text"), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(_TERMS + """SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
  (SELECT q.id AS query_id, d.id AS doc_id, round(sum(q.w * d.w), 6) AS score FROM n q JOIN n d USING (term) WHERE q.side = 'q' AND d.side = 'd' GROUP BY q.id, d.id)) WHERE rank <= 5""")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries against all documents."""
    q = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    return sparse.search(q, table(spark, sf_dir, "documents"), 5)


# --- tables and joins -------------------------------------------------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS query_id, CAST(quality AS VARCHAR) AS doc_id, CAST(coalesce(toxic, 1) AS INT) AS relevance FROM labels")
def qrels_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels read as judgments by place and name."""
    return judgments(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.col("quality").alias("corpus_id"), F.col("toxic").alias("score")))


@query("SELECT doc_id AS query_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def test_queries_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "lang")
    return judged_queries(q, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "query_id"))


@query("SELECT l.doc_id AS query_id, l.doc_id + 1 AS doc_id, sha256(q.text) AS query_sha, sha256(d.text) AS doc_sha FROM labels l JOIN documents q ON q.doc_id = l.doc_id JOIN documents d ON d.doc_id = l.doc_id + 1 WHERE quality = 1")
def train_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents with their successors as relevant pairs; pairs with a missing side fall away."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    qrels = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("query_id"), (F.col("doc_id") + 1).alias("doc_id"))
    pairs = mining.training_pairs(qrels, docs.withColumnRenamed("doc_id", "query_id"), docs)
    return pairs.select("query_id", "doc_id", F.sha2("query_text", 256).alias("query_sha"), F.sha2("doc_text", 256).alias("doc_sha"))


@query("WITH d AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('42:' || o_orderkey)) AS r FROM orders) SELECT o_orderkey, CASE WHEN r <= 500 THEN 'dev' ELSE 'train' END AS split FROM d")
def dev_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.in_dev_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(r"WITH p AS (SELECT l_orderkey AS a, 'part-' || l_partkey AS b FROM lineitem) SELECT count(*) AS n, count(*) FILTER (CAST(a AS VARCHAR) = b) AS exact, count(*) FILTER (regexp_extract(CAST(a AS VARCHAR), '(\d+)', 1) = regexp_extract(b, '(\d+)', 1)) AS by_number FROM p")
def id_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("b"))
    return metrics.id_alignment(pairs, "a", "b")


# --- version store ----------------------------------------------------------------------------------------------------

_TEXT_SQL = r"array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(string_split(x, '#')[1], '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))"


@query(f"SELECT doc_id, sha256('text' || chr(0) || {_TEXT_SQL}) AS sid FROM documents")
def snippet_text_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids of texts that aren't programs."""
    return table(spark, sf_dir, "documents").select("doc_id", text.text_id(F.col("text")).alias("sid"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("snapshot_index"), F.col("source").alias("path"), F.sha2("text", 256).alias("sid"))


_REPORT = """WITH r AS (SELECT doc_id % 5 AS snapshot_index, sha256(text) AS sid FROM documents), f AS (SELECT sid, min(snapshot_index) AS snapshot_index FROM r GROUP BY sid),
p AS (SELECT snapshot_index, count(*) AS n_records, (SELECT count(*) FROM f WHERE f.snapshot_index = r.snapshot_index) AS n_new FROM r GROUP BY snapshot_index)
"""


@query(_REPORT + "SELECT snapshot_index, n_records, n_new, n_records - n_new AS n_unchanged FROM p")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.ingest_report(_records(spark, sf_dir))


@query(_REPORT + "SELECT sum(n_records) * CAST(0.25 AS DOUBLE) AS full_cost, sum(n_new) * CAST(0.25 AS DOUBLE) AS incremental_cost, round(sum(n_records)::DOUBLE / sum(n_new), 5) AS speed_up FROM p")
def rebuild_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.rebuild_cost(store.ingest_report(_records(spark, sf_dir)), 0.25)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("snapshot_index"), F.sha2("event_type", 256).alias("sid"))


_CHAIN = """WITH r AS (SELECT user_id AS path, event_id AS snapshot_index, sha256(event_type) AS sid FROM events),
l AS (SELECT *, lag(sid) OVER (PARTITION BY path ORDER BY snapshot_index) AS b FROM r), c AS (SELECT path, snapshot_index, sid, 'v' || row_number() OVER (PARTITION BY path ORDER BY snapshot_index) AS version FROM l WHERE b IS NULL OR b <> sid)
"""


@query(_CHAIN + "SELECT * FROM c")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions: a user is a path, the kind of event a content."""
    return store.chains(_events(spark, sf_dir))


@query(_CHAIN + "SELECT path, arg_max(sid, snapshot_index) AS sid FROM c GROUP BY path")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(store.chains(_events(spark, sf_dir)))


@query(_CHAIN + "SELECT DISTINCT sid, path FROM c")
def paths_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.paths_of(store.chains(_events(spark, sf_dir)))


@query(_CHAIN + "SELECT count(DISTINCT snapshot_index) AS snapshots, count(DISTINCT sid) AS snippets, (SELECT count(DISTINCT path) FROM c) AS paths, (SELECT count(*) FROM c) AS versions, (SELECT count(DISTINCT sid) FROM r WHERE path % 2 = 0) AS embedded FROM r")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _events(spark, sf_dir)
    return store.stats(r, store.chains(r), r.where("path % 2 = 0"))


@query("SELECT DISTINCT sha256(text) AS sid FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sid"))
    return store.missing_embeddings(docs, docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("sid"))


_PATHS = [(1, "a/b.py"), (2, ".hid/x.py"), (3, "a/.x.py"), (4, "a/b.txt"), (5, "node_modules/y.py"), (6, "a.b/c.py")]


@query(f"WITH s(id, path) AS ({_rows(_PATHS)}) SELECT id, ends_with(path, '.py') AND NOT contains('/' || path, '/.') AS is_code FROM s")
def code_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_PATHS, "id int, path string").select("id", store.is_code_path(F.col("path")).alias("is_code"))


_CHANGES = [(0, "a", "A", "1"), (0, "b", "A", "1"), (1, "a", "M", "2"), (2, "b", "D", None), (4, "b", "A", "3")]


@query(f"WITH c(i, path, status, code) AS ({_rows(_CHANGES)}), n AS (SELECT *, lead(i) OVER (PARTITION BY path ORDER BY i) AS nx FROM c) SELECT CAST(s AS INT) AS snapshot_index, path, code FROM n, unnest(range(i, coalesce(nx, 6))) AS u(s) WHERE status <> 'D'")
def git_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture: listings of six commits from their changes, with a deletion and an addition after it."""
    commits = spark.range(6).select(F.col("id").cast("int").alias("snapshot_index"))
    return store.carried_forward(spark.createDataFrame(_CHANGES, "snapshot_index int, path string, status string, code string"), commits)
