"""Sources, caches, results and the stream of ingests."""

import json
import os
import subprocess

from pyspark.sql import functions as F

from tarn.operators import store
from tarn.sources import caches, results, tables
from tarn.sources.folders import folder_series
from tarn.sources.git import git_changes
from tarn.streaming import standing


def write(folder, **files):
    for name, content in files.items():
        path = os.path.join(folder, name.replace("__", "/") + ".py")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(content)


def test_folders(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write(a, a="x = 1", b="y = 1", node_modules__c="z", d__e="w = 1")
    write(b, a="x = 1", b="y = 2")
    os.makedirs(f"{a}/.git")
    write(a + "/.git", f="hidden")
    r = store.with_content_id(folder_series(spark, [(a, "v1"), (b, "v2")]))
    assert sorted(x.path for x in r.where("snapshot_index = 0").collect()) == ["a.py", "b.py", "d/e.py"]
    assert [(x.n_new, x.n_unchanged) for x in store.ingest_report(r).orderBy("snapshot_index").collect()] == [(3, 0), (1, 1)]


def test_git_history(spark, tmp_path):
    repo = str(tmp_path / "r")
    os.makedirs(repo)
    git = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    write(repo, **{f"m{i}": f"x = {i}\n" for i in range(10)})
    git("add", "."), git("commit", "-qm", "one")
    write(repo, m3="x = 33\n")
    git("commit", "-qam", "two")
    write(repo, m5="x  =  5  # same\n")
    git("rm", "-q", "m6.py"), git("commit", "-qam", "three")
    changes = git_changes(spark, repo)
    commits = spark.range(3).select(F.col("id").cast("int").alias("snapshot_index"))
    full = store.with_content_id(store.carried_forward(changes, commits))
    report = store.ingest_report(full).orderBy("snapshot_index").collect()
    assert [x.n_new for x in report] == [10, 1, 0]
    assert [x.n_unchanged for x in report] == [0, 9, 9]
    assert store.chains(full).groupBy("path").count().where("path = 'm3.py'").first()["count"] == 2
    assert git_changes(spark, repo, 1).select("ref").distinct().count() == 1


def test_tables(spark):
    assert tables.texts(spark, {"a": "x"}).collect() == [("a", "x")]
    assert tables.texts(spark, ["x", "y"]).collect() == [("0", "x"), ("1", "y")]
    q = spark.createDataFrame([(1, 2)], "query_id int, corpus_id int")
    assert tables.judgments(q).collect() == [("1", "2", 1)]


def test_cache_works_out_what_is_missing(spark, tmp_path):
    seen = []

    def work(df):
        seen.append(df.count())
        return df.withColumn("n", F.length("k"))

    make = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    path = str(tmp_path / "c")
    caches.cached(spark, make("a", "bb", "a"), path, ["k"], work)
    out = caches.cached(spark, make("bb", "ccc"), path, ["k"], work)
    assert sorted(out.collect()) == [("bb", 2), ("ccc", 3)] and seen == [2, 1]


def test_store_is_replaced_as_a_whole(spark, tmp_path):
    folder = str(tmp_path / "s")
    for n in (1, 2):
        caches.save({"t": spark.range(n), "u": spark.range(n + 1)}, folder)
    got = caches.load(spark, folder, ["t", "u"])
    assert (got["t"].count(), got["u"].count()) == (2, 3)


def test_results(spark, tmp_path):
    path = str(tmp_path / "r.json")
    scores = dict.fromkeys(("ndcg_at_10", "mrr_at_10", "map_at_10", "recall_at_10"), 0.5)
    results.save(results.result("Task", scores, "rev", "1", 2.0, {"s": {1}}), path)
    assert json.load(open(path))["scores"]["test"][0]["main_score"] == 0.5
    row = results.read(spark, path).first()
    assert row.errors == [] and row.main_score == 0.5


def test_watch_ingests_once(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    spark.createDataFrame([(0, "p", "A")], "snapshot_index int, path string, sid string").write.parquet(folder)
    for _ in range(2):
        standing.watch(spark, folder, "snapshot_index int, path string, sid string", lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    assert sum(seen) == 1
