"""Queries over sources, caches, encoders, ingest, and over programs' limits, probes and versions.

What has no table is made on the fly in a scratch folder, or is a fixture; the SQL then holds the rows expected by hand.
"""

from __future__ import annotations

import os
import string
import subprocess
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import shapes, text
from tarn.operators import benchmark, compare, dense, encode, examples, metrics, programs, rerank, sandbox, store, versions
from tarn.plans.engine import Engine
from tarn.plans.fixtures import CODE_OF, PAIR_SUM, PROGRAMS, VERSIONS, _programs, _statements
from tarn.plans.registry import query, table
from tarn.plans.texts import _NORM, _rows
from tarn.sources import caches, results
from tarn.sources.folders import folder_series
from tarn.sources.git import git_changes
from tarn.streaming import standing


def _scratch(spark: SparkSession) -> str:
    """A new folder: in spark.checkpoint.dir, or for a local session without one a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="tarn-scratch-")
    folder = f"{shared.removeprefix('file://').removeprefix('file:')}/tarn-{uuid.uuid4().hex}"
    if "://" not in folder:
        os.makedirs(folder)
    return folder


def _write(folder: str, files: dict[str, str]) -> str:
    for name, content in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(content)
    return folder


# --- sources and caches -----------------------------------------------------------------------------------------------


@query("SELECT snapshot_index, n_records::BIGINT AS n_records, n_new::BIGINT AS n_new, n_unchanged::BIGINT AS n_unchanged FROM (VALUES (0, 3, 3, 0), (1, 2, 1, 1)) AS v(snapshot_index, n_records, n_new, n_unchanged)")
def folder_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of a folder, with hidden files and others that aren't looked at."""
    at = _scratch(spark)
    a = _write(f"{at}/a", {"a.py": "x = 1", "b.py": "y = 1", "node_modules/c.py": "z", "d/e.py": "w = 1", ".git/f.py": "hidden", "g.txt": "text"})
    b = _write(f"{at}/b", {"a.py": "x = 1  # the same", "b.py": "y = 2"})
    return store.ingest_report(store.with_content_id(folder_series(spark, [(a, "v1"), (b, "v2")])))


def _git(repo: str, *args: str) -> None:
    env = {"GIT_AUTHOR_DATE": "2024-01-01T00:00:00Z", "GIT_COMMITTER_DATE": args[0] if args[0][:2] == "20" else "2024-01-01T00:00:00Z", "PATH": os.environ["PATH"], "HOME": repo}
    words = args[1:] if args[0][:2] == "20" else args
    subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@example.com", *words], check=True, capture_output=True, env=env)


def _repository(folder: str) -> str:
    """A repository of five commits: a branch adds one file and removes another and is merged."""
    repo = _write(folder, {"a.py": "x = 1\n", "b.py": "y = 1\n", ".hidden/h.py": "h = 1\n", "t.txt": "text\n"})
    _git(repo, "init", "-q", "-b", "main")
    _git(repo, "add", "."), _git(repo, "2024-01-01T00:00:00Z", "commit", "-qm", "one")
    _git(repo, "checkout", "-qb", "side")
    _write(repo, {"c.py": "z = 1\n"})
    _git(repo, "add", "."), _git(repo, "rm", "-q", "b.py"), _git(repo, "2024-01-02T00:00:00Z", "commit", "-qm", "side")
    _git(repo, "checkout", "-q", "main")
    _write(repo, {"a.py": "x = 2\n"})
    _git(repo, "2024-01-03T00:00:00Z", "commit", "-qam", "main")
    _git(repo, "2024-01-04T00:00:00Z", "merge", "-q", "--no-ff", "-m", "merge", "side")
    _write(repo, {"d.py": "w = 1\n"})
    _git(repo, "add", "."), _git(repo, "2024-01-05T00:00:00Z", "commit", "-qm", "last")
    return repo


_LISTINGS = [(0, "a.py=x = 1,b.py=y = 1"), (1, "a.py=x = 1,c.py=z = 1"), (2, "a.py=x = 2,b.py=y = 1"), (3, "a.py=x = 2,c.py=z = 1"), (4, "a.py=x = 2,c.py=z = 1,d.py=w = 1")]


@query(f"SELECT * FROM ({_rows(_LISTINGS)}) AS v(snapshot_index, files)")
def git_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each commit's files, from what the commits change; after a merge, too."""
    changes = git_changes(spark, _repository(_scratch(spark)))
    listed = store.carried_forward(changes, changes.select("snapshot_index").distinct())
    files = F.array_sort(F.collect_list(F.concat("path", F.lit("="), F.trim(F.regexp_replace("code", "\n", "")))))
    return listed.groupBy("snapshot_index").agg(F.array_join(files, ",").alias("files"))


@query("SELECT * FROM (VALUES (2, 0, 1)) AS v(commits, first_index, last_index)")
def git_last_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the last two commits, numbered from 0; the first is a full listing."""
    c = git_changes(spark, _repository(_scratch(spark)), 2)
    return c.agg(F.count_distinct("ref").cast("int").alias("commits"), F.min("snapshot_index").alias("first_index"), F.max("snapshot_index").alias("last_index"))


@query("SELECT doc_id, length(text) AS n FROM documents")
def cached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results looked up by text, those that are missing worked out: half of the documents first, then all."""
    docs, folder = table(spark, sf_dir, "documents").withColumn("key", caches.text_key()), _scratch(spark) + "/cache"
    work = lambda missing: missing.select("key", F.length("text").cast("long").alias("n"))
    caches.cached(spark, docs.where("doc_id % 2 = 0").select("key", "text"), folder, ["key"], work)
    found = caches.cached(spark, docs.select("key", "text"), folder, ["key"], work)
    return docs.select("doc_id", "key").join(found, "key").select("doc_id", "n")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels")
def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store written twice and read."""
    folder = _scratch(spark) + "/store"
    tables = {n: table(spark, sf_dir, n) for n in ("documents", "labels")}
    for limit in (3, None):
        caches.save({n: t if limit is None else t.limit(limit) for n, t in tables.items()}, folder)
    got = caches.load(spark, folder, [*tables])
    return got["documents"].agg(F.count("*").alias("documents")).crossJoin(got["labels"].agg(F.count("*").alias("labels")))


@query("SELECT * FROM (VALUES ('', 0.5::DOUBLE), ('main_score out of range|ndcg_at_10 out of range', 1.5::DOUBLE)) AS v(errors, main_score)")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files written, read and checked."""
    folder = _scratch(spark)
    for name, score in (("good", 0.5), ("bad", 1.5)):
        scores = dict.fromkeys(("mrr_at_10", "map_at_10", "recall_at_10"), 0.5) | {"ndcg_at_10": score}
        results.save(results.result("task", scores, "revision", "1", 2.0, {"seen": {1}}), f"{folder}/{name}.json")
    return results.read(spark, folder + "/*.json").select(F.array_join(F.array_sort("errors"), "|").alias("errors"), "main_score")


# --- texts and encoders -----------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, length(text) AS n_raw, sha256(CASE WHEN {_NORM.format(c='text', n=32000)} = '' THEN ' ' ELSE {_NORM.format(c='text', n=32000)} END) AS sha FROM documents")
def both_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's raw text beside the normalised one, blank ones as a space."""
    new = text.or_blank(text.normalise_query(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_raw"), F.sha2(new, 256).alias("sha"))


def _letters() -> encode.Model:
    """A model of a kind: how often each letter stands in a text."""
    return lambda texts: np.array([[t.lower().count(c) for c in string.ascii_lowercase] for t in texts], np.float64).reshape(len(texts), 26)


_LETTERS = "[" + ", ".join(f"length(lower(t)) - length(replace(lower(t), '{c}', ''))" for c in string.ascii_lowercase) + "]"
_ENCODED = f"""WITH t AS (SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'q', CAST(item_id AS VARCHAR), coalesce(text, '') FROM benchmark),
v AS (SELECT side, id, CAST({_LETTERS} AS DOUBLE[]) AS v FROM t), e AS (SELECT side, id, CAST(list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-9)) AS FLOAT[])::DOUBLE[] AS e FROM v)
"""


@query(_ENCODED + "SELECT id AS doc_id, round(list_sum(e), 4) AS total FROM e WHERE side = 'd'")
def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a model that each worker loads once."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    vectors = encode.encoder("letters", _letters)(docs, "doc_id", "text")
    return vectors.select("doc_id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query(_ENCODED + """SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
  (SELECT q.id AS query_id, d.id AS doc_id, round(list_inner_product(q.e, d.e), 5) AS score FROM e q, e d WHERE q.side = 'q' AND d.side = 'd')) WHERE rank <= 3""")
def encoder_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine with an encoder and without verification: benchmark items against documents."""
    plain = lambda t, key, column: encode.encoder("letters", _letters)(t, key, column)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    return dense.topk(plain(items, "query_id", "text"), plain(docs, "doc_id", "text"), 3)


# --- ingest -----------------------------------------------------------------------------------------------------------


def _code_vectors(codes: list[str]) -> list[list[float]]:
    return [[float(c.count("x")), float(c.count("y")), float(c.count("z")), 1.0] for c in codes]


@query("SELECT * FROM (VALUES ('about_x', 'b.py,a.py,c.py,d.py', true), ('about_y', 'a.py,b.py,c.py,d.py', true)) AS v(name, paths, changed)")
def ingest_and_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository is ingested, then a folder: what is new is encoded, the standing questions are asked again."""
    at = _scratch(spark)
    asked = spark.createDataFrame([("about_x", [1.0, 0.0, 0.0, 0.0]), ("about_y", [0.0, 1.0, 0.0, 0.0])], "name string, vec array<float>")
    first = standing.ingest(spark, _repository(f"{at}/r"), asked, _code_vectors)
    later = _write(f"{at}/f", {"a.py": "yyy = 3\n", "d.py": "w = 1\n", "b.py": "xx = 2\n"})
    return standing.ingest(spark, later, asked, _code_vectors, first).answers.select("name", F.array_join("paths", ",").alias("paths"), "changed")


@query("SELECT source AS path, count(*) AS n FROM documents GROUP BY source")
def watched_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that come to a folder are taken once each: the documents in two steps, the second one run again."""
    at, schema = _scratch(spark), "path string, doc_id bigint"
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), "doc_id")
    for part in (0, 1):
        rows.where(F.col("doc_id") % 2 == part).write.mode("append").parquet(f"{at}/in")
        for _ in range(1 + part):
            standing.watch(spark, f"{at}/in", schema, lambda batch, n: batch.write.mode("append").parquet(f"{at}/out"), f"{at}/checkpoint")
    return spark.read.schema(schema).parquet(f"{at}/out").groupBy("path").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id AS path, event_id AS snapshot_index, sha256(event_type) AS sid FROM events WHERE user_id = (SELECT min(user_id) FROM events)), l AS (SELECT *, lag(sid) OVER (ORDER BY snapshot_index) AS b FROM r)
SELECT snapshot_index, sid FROM l WHERE b IS NULL OR b <> sid""")
def path_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path's entries; the first user stands for it."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("user_id").alias("u")).first()["u"]
    records = events.select(F.col("user_id").alias("path"), F.col("event_id").alias("snapshot_index"), F.sha2("event_type", 256).alias("sid"))
    return store.history(store.chains(records), first).select("snapshot_index", "sid")


# --- programs ---------------------------------------------------------------------------------------------------------

_LIMITED = [
    ("memory", "x = bytearray(4 << 30)\nprint(len(x))", "error"), ("file", "open('f', 'wb').write(b'0' * (64 << 20))\nprint(1)", "error"), ("time", "while True:\n    pass", "timeout"),
    ("sleep", "import time\ntime.sleep(60)", "timeout"), ("silent", "x = 1", "empty_output"), ("syntax", "def f(:", "syntax_error"), ("exit", "import sys\nsys.exit(3)", "error"),
    ("old", "print raw_input()", "ok"), ("returns", "print(input())\nreturn", "ok"), ("call", "def solve(a, b):\n    return a + b", "ok"), ("folder", "import os\nprint(len(os.listdir('.')))", "ok"),
]


@query(f"SELECT doc_id, status FROM ({_rows(_LIMITED)}) AS v(doc_id, code, status)")
def sandbox_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What programs come to that use too much, print nothing, are old, or only define a function."""
    one = F.array(F.struct(F.lit("1 2\n").alias("stdin"), F.lit("3").alias("expected"), F.lit(0).alias("idx")))
    pairs = spark.createDataFrame([r[:2] for r in _LIMITED], "doc_id string, code string").select(F.lit("q").alias("query_id"), "doc_id", "code", one.alias("examples"), F.lit(False).alias("any_order"))
    return sandbox.verify_pairs(pairs).select("doc_id", F.col("first_status").alias("status"))


@query("SELECT * FROM (VALUES ('timeout', 4), ('timeout_skipped', 3)) AS v(status, n)")
def sandbox_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One endless program under seven ids: it is given up after four timeouts, whatever ids it goes by."""
    one = F.array(F.struct(F.lit("").alias("stdin"), F.lit("3").alias("expected"), F.lit(0).alias("idx")))
    pairs = spark.range(7).select(F.lit("q").alias("query_id"), F.col("id").cast("string").alias("doc_id"), F.lit(CODE_OF["p_loop"]).alias("code"), one.alias("examples"), F.lit(False).alias("any_order"))
    return sandbox.verify_pairs(pairs).groupBy(F.col("first_status").alias("status")).agg(F.count("*").cast("int").alias("n"))


@query("SELECT code, seen || ',__main__,solution.py' AS seen FROM (VALUES ('n = int(input())', '9'), ('s = input().upper()', '9'), ('m = [4, 5]', '4,5')) AS v(code, seen)")
def traced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a program's variables take while it runs; its own name and file's are among them."""
    seen = F.udf(lambda code: ",".join(v for v in sandbox.run(code + "\nprint(1)", "9\n", trace=True).values or ()), "string")
    return spark.createDataFrame([("n = int(input())",), ("s = input().upper()",), ("m = [4, 5]",)], "code string").select("code", seen("code").alias("seen"))


_BATTERIES = [(1, "3\n1 2\n3 4\n5 6\n", True), (2, "5\n", False), (3, "2\n1 a.b\n-3 4\n2 2\n7 7\n", True), (4, "word 1.50\n", False), (5, "", False)]


@query(f"SELECT id, 8 AS n, true AS first_is_example, true AS same_layout, counted AND id IN (1, 3) AS count_stays FROM ({_rows([(i, s, str(c).upper() == 'TRUE') for i, s, c in _BATTERIES])}) AS v(id, stdin, counted)".replace("True", "true").replace("False", "false"))
def probe_batteries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs made from an example: how many, and what they keep of it."""
    layout = lambda s: [len(x.split()) for x in s.split("\n") if x.strip()]
    rows = []
    for i, stdin, counted in _BATTERIES:
        got = versions.probes(stdin)
        alike = all(layout(p) == layout(got[0]) for p in got) if stdin else all(p.strip().isdigit() for p in got[1:])
        rows.append((i, len(got), got[0].strip() == stdin.strip(), alike and versions.probes(stdin) == got and len(set(got)) > 2, counted and {p.split("\n")[0] for p in got} == {stdin.split("\n")[0]}))
    return spark.createDataFrame(rows, "id int, n int, first_is_example boolean, same_layout boolean, count_stays boolean")


@query("SELECT * FROM (VALUES (1, NULL, 0.5::DOUBLE), (2, 'b = 3', 0.35::DOUBLE), (3, NULL, 0.5::DOUBLE), (4, 'b = 3', 0.35::DOUBLE)) AS v(idx, diff_text, blended)")
def blended_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version changes, and similarity blended with the change's; a version without a change has the global one."""
    rows = spark.createDataFrame([("q", 1, "a = 1\nb = 2"), ("q", 2, "a = 1\nb = 3"), ("q", 3, "a = 1\nb = 3"), ("q", 4, "a = 1")], "query_id string, idx int, code string")
    d = versions.with_diff_text(rows)
    score = F.when(F.col("diff_text").isNotNull(), F.lit(0.2))
    return d.select("idx", "diff_text", F.round(versions.blended(F.lit(0.5), score, 0.5, 0.5), 5).alias("blended"))


@query("SELECT * FROM (VALUES (1, 'fingerprint #abcdef01|PASSED 2/2 examples'), (2, 'fingerprint #abcdef01|behaviorally unchanged'), (3, 'FAILED 1/2 examples'), (4, '')) AS v(id, badges)")
def version_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, 2, 2, "abcdef0123", False), (2, 2, 2, "abcdef0123", True), (3, 1, 2, None, False), (4, 0, 0, None, False)], "id int, passed int, total int, digest string, unchanged boolean")
    return rows.select("id", F.array_join(versions.badges(F.col("passed"), F.col("total"), F.col("digest"), F.col("unchanged")), "|").alias("badges"))


@query("SELECT * FROM (VALUES (1, 1), (2, 2), (3, 2), (4, 4)) AS v(idx, same_as)")
def cached_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints kept by content id and battery; the second call finds all of them. A remark doesn't change a digest."""
    v = store.with_content_id(spark.createDataFrame(VERSIONS, "query_id string, idx int, code string"))
    q = examples.with_examples(spark.createDataFrame([("q", PAIR_SUM)], "query_id string, text string")).select("query_id", F.get("examples", F.lit(0))["stdin"].alias("stdin"))
    rows, folder = v.join(F.broadcast(q), "query_id"), _scratch(spark) + "/fingerprints"
    for _ in range(2):
        found = versions.cached_fingerprints(spark, rows, folder)
    first = found.groupBy("digest").agg(F.min("idx").alias("same_as"))
    return found.join(first, "digest").select("idx", "same_as")


@query("SELECT * FROM (VALUES ('faults compile', true), ('faults change the tree', true), ('cosmetic changes keep the tree', true), ('the same seed gives the same', true)) AS v(what, holds)")
def changed_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty and cosmetic versions of programs."""
    codes = [c for n, c in PROGRAMS if n not in ("p_bad", "p_old", "p_loop")]
    faults = [(c, benchmark.faulty(c, s)) for c in codes for s in range(3)]
    tree = lambda c: store.normalised(c)[0]
    rows = [
        ("faults compile", all(programs.runnable(f)[0] for _, f in faults)), ("faults change the tree", all(tree(f) != tree(c) for c, f in faults)),
        ("cosmetic changes keep the tree", all(tree(benchmark.cosmetic(c, s)) == tree(c) for c in codes for s in range(3))), ("the same seed gives the same", all(benchmark.faulty(c, 2) == benchmark.faulty(c, 2) for c in codes)),
    ]
    return spark.createDataFrame(rows, "what string, holds boolean")


@query("SELECT * FROM (VALUES ('p_sq', true, true), ('p_old', false, true), ('p_dbl', false, false)) AS v(doc_id, naive, passes)")
def naive_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the naive harness passes, beside the one that repairs old programs."""
    s = examples.with_examples(_statements(spark)).where("query_id = 'st1'").withColumn("any_order", F.lit(False))
    pairs = s.crossJoin(F.broadcast(_programs(spark).where("doc_id IN ('p_sq', 'p_old', 'p_dbl')"))).select("query_id", "doc_id", "code", "examples", "any_order")
    naive = benchmark.with_naive(pairs).select("query_id", "doc_id", "naive")
    return naive.join(sandbox.verify_pairs(pairs), ["query_id", "doc_id"]).select("doc_id", "naive", (F.col("passed") == F.col("total")).alias("passes"))


@query("SELECT * FROM (VALUES ('error', 5), ('wrong_output', 3), ('syntax_error', 1), ('timeout', 1)) AS v(kind, n)")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why programs fail a statement."""
    s = examples.with_examples(_statements(spark)).where("query_id = 'st1'").withColumn("any_order", F.lit(False))
    pairs = s.crossJoin(F.broadcast(_programs(spark))).select("query_id", "doc_id", "code", "examples", "any_order")
    return benchmark.failures(sandbox.verify_pairs(pairs)).select("kind", F.col("n").cast("int").alias("n"))


@query("SELECT * FROM (VALUES ('ok', 1), ('error', 1), ('timeout', 1)) AS v(first_status, n)")
def unseen_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without a verdict yet are verified, and statuses counted."""
    c = spark.createDataFrame([("q", n, CODE_OF[n]) for n in ("p_sq", "p_div", "p_loop", "p_rev")], "query_id string, doc_id string, code string")
    todo = rerank.unseen(c, spark.createDataFrame([("q", "p_rev")], "query_id string, doc_id string"))
    one = F.array(F.struct(F.lit("4\n").alias("stdin"), F.lit("16").alias("expected"), F.lit(0).alias("idx")))
    return rerank.status_counts(sandbox.verify_pairs(todo.select("query_id", "doc_id", "code", one.alias("examples"), F.lit(False).alias("any_order")))).select("first_status", F.col("n").cast("int").alias("n"))


@query("SELECT * FROM (VALUES ('p_sq', 1, 'PASSED 1/1 examples'), ('p_dbl', 2, 'FAILED 0/1 examples')) AS v(doc_id, final_rank, badge)")
def kept_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine with a folder of verdicts, asked twice: the second time nothing is run."""
    corpus = {n: CODE_OF[n] for n in ("p_sq", "p_dbl")}
    engine = Engine(spark, alpha=3.0, verdicts=_scratch(spark) + "/verdicts").index(corpus)
    for _ in range(2):
        found = engine.retrieve({"s": "n int input\nPrint the square.\n-----Sample Input-----\n4\n-----Sample Output-----\n16\n"}, 2)
    return found.select("doc_id", "final_rank", "badge")


_RECORDED = [("r0", "ndcg", 0.56825), ("r1", "ndcg", 0.6), ("r2", "ndcg", 0.87122)]
_MEASURED = [("r0", "ndcg", 0.569), ("r2", "ndcg", 0.85)]


@query(f"""WITH a(rung, metric, score) AS ({_rows(_RECORDED)}), b(rung, metric, now) AS ({_rows(_MEASURED)})
SELECT a.rung, round(CAST(now AS DOUBLE) - CAST(score AS DOUBLE), 5) AS difference, CASE WHEN now IS NULL THEN 'not run' WHEN abs(now - score) <= 0.002 THEN 'same' ELSE 'differs' END AS state FROM a LEFT JOIN b USING (rung, metric)""")
def reproduced_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded scores against those measured now."""
    make = lambda rows: spark.createDataFrame(rows, "rung string, metric string, score double")
    return metrics.reproduced(make(_RECORDED), make(_MEASURED)).select("rung", "difference", "state")


# --- the same operators over the given tables ---------------------------------------------------------------------------


_SIDES = "(SELECT doc_id AS id, text AS a, lead(text) OVER (ORDER BY doc_id) AS e FROM documents)"


@query(rf"""WITH t AS (SELECT id, list_filter(string_split_regex(coalesce(a, ''), '\s+'), lambda x: x <> '') AS s, list_filter(string_split_regex(coalesce(a, '') || ' x', '\s+'), lambda x: x <> '') AS t FROM {_SIDES} AS v)
SELECT id AS doc_id, len(s) AS n, true AS own, len(s) = len(t) AS longer FROM t""")
def compare_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document compared token by token with itself, with its spaces doubled, and with a word more."""
    t = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n"), compare.tokens_match(t, F.replace(t, F.lit(" "), F.lit("  "))).alias("own"), compare.tokens_match(t, F.concat(t, F.lit(" x"))).alias("longer"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM documents)
SELECT doc_id, len(l) AS n_lines, CASE WHEN len(l) > 0 THEN len(list_filter(string_split_regex(l[1], '\s+'), lambda x: x <> '')) ELSE 0 END AS first_line_tokens FROM l""")
def document_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout of every document, read as if it were an input."""
    s = shapes.example_shape(F.col("text"))
    return table(spark, sf_dir, "documents").withColumn("s", s).select("doc_id", F.col("s.n_lines").cast("long").alias("n_lines"), F.col("s.first_line_tokens").cast("long").alias("first_line_tokens"))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(coalesce(html, ''), '^\s+|\s+$', '', 'g') AS t FROM pages), p AS (SELECT page_id, t, string_split_regex(t, '(?i)\n(?:examples?|sample input)')[1] AS head FROM h)
SELECT page_id, sha256(substr(regexp_replace(regexp_replace(CASE WHEN length(head) > 100 THEN head ELSE t END, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), 1, 32000)) AS sha FROM p""")
def pages_without_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.normalise_query(F.col("html"), without_examples=True), 256).alias("sha"))


@query("SELECT source_format, reason, count(*) AS n FROM (SELECT 'none' AS source_format, CASE WHEN coalesce(text, '') = '' THEN 'empty_statement' ELSE 'no_example_section' END AS reason FROM benchmark) GROUP BY ALL")
def parsed_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items read as statements: none has an example."""
    return examples.with_examples(table(spark, sf_dir, "benchmark")).groupBy("source_format", "reason").agg(F.count("*").alias("n"))
