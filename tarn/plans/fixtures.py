"""Queries over small programs and statements of our own: parsing, comparison, signatures, execution, version ranking.

The given tables hold no programs. Where SQL can't compute an operator, its SQL here holds the rows expected by hand.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import shapes
from tarn.functions.text import allows_any_order, statement_numbers
from tarn.operators import benchmark, compare, examples, metrics, programs, rerank, sandbox, store, versions
from tarn.plans.registry import query
from tarn.plans.texts import _rows

STATEMENTS = [
    ("st1", "Print the square.\n-----Sample Input-----\n4\n-----Sample Output-----\n16\n"),
    ("st2", "Twice.\n-----Sample Input 1-----\n2\n-----Sample Output 1-----\n7\n-----Sample Input 2-----\n3\n-----Sample Output 2-----\n44\n"),
    ("st3", "Example 1:\nInput: nums = [2,7,11,15], target = 9\nOutput: [0,1]\n\nExample 2:\nInput: nums = [3,2,4], target = 6\nOutput: [1,2]\n"),
    ("st4", "-----Examples-----\nInput\n3\n1 2 3\n\nOutput\n6\n\n-----Note-----\nSum.\n"),
    ("st5", "-----Input-----\nAn integer.\n-----Output-----\nIts square.\n"),
    ("st6", ""),
    ("st7", "-----Sample Input-----\n4\n"),
    ("st8", "Print the square.\n-----Sample Input-----\n4\n-----Sample Output-----\n16\n\nThe answer is four times four because we square it."),
    ("st9", "Echo.\n-----Sample Input-----\n$5$\n-----Sample Output-----\n$5$\n"),
    ("st10", "Compute the shortest path in a weighted graph."),
    ("st11", "Add one. Two samples.\nSample Input 1\n1\nSample Output 1\n2\n"),
]
_PARSED = [
    ("st1", "dashed_sample", "", '[["4\n","16\n"]]'), ("st2", "dashed_sample", "", '[["2\n","7\n"],["3\n","44\n"]]'),
    ("st3", "leetcode", "", '[["nums = [2,7,11,15], target = 9\n","[0,1]\n"],["nums = [3,2,4], target = 6\n","[1,2]\n"]]'),
    ("st4", "codeforces", "", '[["3\n1 2 3\n","6\n"]]'), ("st5", "none", "no_example_section", "[]"), ("st6", "none", "empty_statement", "[]"),
    ("st7", "none", "sample_headers_unpaired", "[]"), ("st8", "dashed_sample", "", '[["4\n","16\n"]]'), ("st9", "dashed_sample", "", '[["5\n","5\n"]]'),
    ("st10", "none", "no_example_section", "[]"), ("st11", "bare_markers", "", '[["1\n","2\n"]]'),
]

PROGRAMS = [
    ("p_sq", "n = int(input())\nprint(n * n)"), ("p_dbl", "n = int(input())\nprint(n * 2)"), ("p_rev", "s = input()\nprint(s[::-1])"),
    ("p_sum", "n=int(input())\nfor _ in range(n):\n    a,b=map(int,input().split())\n    print(a+b)"),
    ("p_tc", "t = int(input())\nfor _ in range(t):\n    n = int(input())\n    print(n + 1)"),
    ("p_cls", "class Solution:\n    def solve(self, a, b):\n        return a + b"), ("p_bad", "def f(:\n  pass"), ("p_loop", "while True:\n    pass"),
    ("p_div", "print(1 // 0)"), ("p_exit", "import sys\nprint('DONE')\nsys.exit(0)"), ("p_fd", "a, b = map(int, open(0).read().split())\nprint(a * b)"),
    ("p_old", "n = int(raw_input())\nprint n * n"),
]
_SHAPES = {"p_sq": "single-line", "p_dbl": "single-line", "p_rev": "single-line", "p_sum": "n-then-n-lines", "p_tc": "multi-case-t", "p_cls": "functional", "p_fd": "token-line"}
_SIGNED = [(n, _SHAPES.get(n, "unknown"), {"p_tc": 2, "p_sum": 2}.get(n, 0 if _SHAPES.get(n, "unknown") in ("unknown", "functional") else 1), 0 if n in ("p_bad", "p_old") else 1) for n, _ in PROGRAMS]


CODE_OF = dict(PROGRAMS)


def _statements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATEMENTS, "query_id string, text string")


def _programs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROGRAMS, "doc_id string, code string")


@query(f"SELECT * FROM ({_rows(_PARSED)}) AS v(query_id, source_format, reason, pairs)")
def parse_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = examples.with_examples(_statements(spark))
    pairs = F.concat(F.lit("["), F.array_join(F.transform("examples", lambda e: F.concat(F.lit('["'), e["stdin"], F.lit('","'), e["expected"], F.lit('"]'))), ","), F.lit("]"))
    return p.select("query_id", "source_format", "reason", pairs.alias("pairs"))


@query(f"SELECT reason, count(*) AS n FROM ({_rows(_PARSED)}) AS v(query_id, source_format, reason, pairs) WHERE reason <> '' GROUP BY reason")
def parse_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.with_examples(_statements(spark)).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH v AS (SELECT *, CASE WHEN query_id IN ('st2', 'st3') THEN '2' WHEN reason = '' THEN '1' ELSE '0' END AS k FROM ({_rows(_PARSED)}) AS p(query_id, f, reason, pairs))
SELECT 'format' AS kind, f AS value, count(*) AS n FROM v GROUP BY f UNION ALL SELECT 'reason', reason, count(*) FROM v WHERE reason <> '' GROUP BY reason UNION ALL SELECT 'examples', k, count(*) FROM v GROUP BY k""")
def example_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.audit(examples.with_examples(_statements(spark)))


COMPARED = [
    (1, "42\n", "42", False), (2, "1 2 3\n", "1\n2\n3", False), (3, "3.14159265", "3.1415926500001", False), (4, "3.14", "3.24", False), (5, "YES", "Yes", False), (6, "possible", "POSSIBLE", False),
    (7, "abc", "ABC", False), (8, "True", "true", False), (9, "[0,1]", "[0, 1]", False), (10, "42", "", False), (11, "apple\nbanana\ncherry", "cherry\napple\nbanana", True),
    (12, "apple\nbanana\ncherry", "cherry\napple\nbanana", False), (13, "b a", "a b", True), (14, "nan", "1", False), (15, "(1, 2.0)", "[1, 2.0000001]", False), (16, "{'a': true}", '{"a": true}', False),
]
_REASONS = ["exact_match", "token_match", "token_match", "token_mismatch", "token_match", "token_match", "token_mismatch", "literal_match", "literal_match", "empty_mismatch", "line_set_match", "token_mismatch", "token_multiset_match", "token_mismatch", "literal_match", "literal_match"]


def _compared(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPARED, "id int, actual string, expected string, any_order boolean")


@query(f"SELECT id, reason, reason LIKE '%\\_match' ESCAPE '\\' AS matched FROM ({_rows([(i + 1, r) for i, r in enumerate(_REASONS)])}) AS v(id, reason)")
def compare_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compare.comparison(F.col("actual"), F.col("expected"), F.col("any_order"))
    return _compared(spark).withColumn("c", c).select("id", "c.reason", "c.matched")


_PAIRS_SQL = _rows([(i, a, e) for i, a, e, _ in COMPARED])


@query(rf"""WITH v(id, a, e) AS ({_PAIRS_SQL}), t AS (SELECT id, list_filter(string_split_regex(a, '\s+'), lambda x: x <> '') AS s, list_filter(string_split_regex(e, '\s+'), lambda x: x <> '') AS t FROM v),
z AS (SELECT id, unnest(s) AS x, unnest(t) AS y FROM t WHERE len(s) = len(t)), o AS (SELECT id, bool_and(x = y OR (lower(x) = lower(y) AND lower(x) IN ('yes', 'no', 'true', 'false', 'possible', 'impossible'))
  OR coalesce(isfinite(try_cast(x AS DOUBLE)) AND isfinite(try_cast(y AS DOUBLE)) AND abs(try_cast(x AS DOUBLE) - try_cast(y AS DOUBLE)) <= 1e-6 * greatest(1.0, abs(try_cast(y AS DOUBLE))), false)) AS ok FROM z GROUP BY id)
SELECT t.id, CASE WHEN len(s) = len(t) THEN coalesce(ok, true) ELSE false END AS matched FROM t LEFT JOIN o USING (id)""")
def compare_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token-wise step alone, in columns."""
    return _compared(spark).select("id", compare.tokens_match(F.col("actual"), F.col("expected")).alias("matched"))


@query(rf"""WITH v(id, a, e) AS ({_PAIRS_SQL}), t AS (SELECT id, list_sort(list_filter(list_transform(string_split(a, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS la, list_sort(list_filter(list_transform(string_split(e, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS le,
  list_sort(list_filter(string_split_regex(a, '\s+'), lambda x: x <> '')) AS ta, list_sort(list_filter(string_split_regex(e, '\s+'), lambda x: x <> '')) AS te FROM v)
SELECT id, len(la) > 1 AND la = le AS lines, len(ta) > 1 AND ta = te AS tokens FROM t""")
def compare_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, e = F.col("actual"), F.col("expected")
    return _compared(spark).select("id", compare.lines_match_any_order(a, e).alias("lines"), compare.tokens_match_any_order(a, e).alias("tokens"))


INPUTS = [(1, "3\n1 2\n3 4\n5 6\n"), (2, "2\n1 2\n3\n4 5 6\n7\n"), (3, "hello world\n"), (4, ""), (5, "5\n"), (6, "1.5 x\n\n2\n"), (7, "0\n1\n")]
_SHAPE_SQL = rf"""v(id, t) AS ({_rows(INPUTS)}), l AS (SELECT id, list_filter(string_split(replace(t, chr(13), ''), chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM v),
f AS (SELECT id, len(l) AS n_lines, list_filter(string_split_regex(coalesce(l[1], ''), '\s+'), lambda x: x <> '') AS f, l FROM l),
s AS (SELECT id, n_lines, CASE WHEN n_lines > 0 THEN len(f) ELSE 0 END AS first_line_tokens, CASE WHEN len(f) = 1 AND regexp_full_match(f[1], '[-+]?\d+') THEN CAST(f[1] AS BIGINT) END AS first_token_int,
  n_lines > 0 AND len(list_filter(list_filter(string_split_regex(array_to_string(l, ' '), '\s+'), lambda x: x <> ''), lambda x: NOT regexp_full_match(x, '[-+]?\d+(\.\d+)?'))) = 0 AS all_numeric FROM f),
e AS (SELECT *, coalesce(first_token_int > 0 AND n_lines - 1 = first_token_int, false) AS n_then_n_lines FROM s),
shape AS (SELECT *, coalesce(first_token_int >= 1 AND first_token_int < n_lines - 1 AND (n_lines - 1) % greatest(first_token_int, 1) = 0 AND NOT n_then_n_lines, false) AS multi_case_t FROM e)"""


@query(f"WITH {_SHAPE_SQL} SELECT id, CAST(n_lines AS INT) AS n_lines, CAST(first_line_tokens AS INT) AS first_line_tokens, CAST(first_token_int AS VARCHAR) AS first_token_int, all_numeric, n_then_n_lines, multi_case_t FROM shape")
def example_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(INPUTS, "id int, t string").withColumn("s", shapes.example_shape(F.col("t"))).select("id", "s.*").withColumn("first_token_int", F.col("first_token_int").cast("string"))


def _signature_rows() -> str:
    return _rows(_SIGNED)


@query(f"""WITH {_SHAPE_SQL}, p(doc_id, io_shape, calls, valid) AS ({_signature_rows()})
SELECT CAST(id AS VARCHAR) AS query_id, doc_id FROM shape, p WHERE valid = 1 AND CASE io_shape WHEN 'unknown' THEN false WHEN 'functional' THEN false WHEN 'single-line' THEN n_lines = 1
  WHEN 'multi-case-t' THEN multi_case_t OR (first_token_int IS NOT NULL AND n_lines > 1) WHEN 'n-then-n-lines' THEN n_then_n_lines OR n_lines > 1 ELSE true END""")
def shape_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which programs can read which inputs."""
    s = spark.createDataFrame(INPUTS, "id int, t string").select(F.col("id").cast("string").alias("query_id"), shapes.example_shape(F.col("t")).alias("shape"))
    return programs.gate(programs.with_signature(_programs(spark)), s)


@query(f"SELECT doc_id, io_shape, CAST(calls AS INT) AS input_calls, valid = 1 AS is_valid_syntax FROM ({_signature_rows()}) AS v(doc_id, io_shape, calls, valid)")
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.with_signature(_programs(spark)).select("doc_id", "io_shape", "input_calls", "is_valid_syntax")


@query(f"SELECT CASE WHEN valid = 1 THEN io_shape ELSE 'syntax_error' END AS io_shape, count(*) AS n FROM ({_signature_rows()}) AS v(doc_id, io_shape, calls, valid) GROUP BY 1")
def gate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.coverage(programs.with_signature(_programs(spark)))


def _pairs(spark: SparkSession) -> DataFrame:
    s = examples.with_examples(_statements(spark)).where("query_id IN ('st1', 'st3')").withColumn("any_order", allows_any_order(F.col("text")))
    two = _programs(spark).unionByName(spark.createDataFrame([("p_two", "class Solution:\n    def twoSum(self, nums, target):\n        seen = {}\n        for i, x in enumerate(nums):\n            if target - x in seen:\n                return [seen[target - x], i]\n            seen[x] = i")], "doc_id string, code string"))
    return s.crossJoin(F.broadcast(two)).select("query_id", "doc_id", "code", "examples", "any_order")


_VERDICTS = [
    ("st1", "p_sq", 1, 1, "ok"), ("st1", "p_dbl", 0, 1, "ok"), ("st1", "p_rev", 0, 1, "ok"), ("st1", "p_sum", 0, 1, "error"), ("st1", "p_tc", 0, 1, "error"), ("st1", "p_cls", 0, 1, "error"), ("st1", "p_bad", 0, 1, "syntax_error"),
    ("st1", "p_loop", 0, 1, "timeout"), ("st1", "p_div", 0, 1, "error"), ("st1", "p_exit", 0, 1, "ok"), ("st1", "p_fd", 0, 1, "error"), ("st1", "p_old", 1, 1, "ok"), ("st1", "p_two", 0, 1, "error"),
    ("st3", "p_sq", 0, 2, "error"), ("st3", "p_dbl", 0, 2, "error"), ("st3", "p_rev", 0, 2, "ok"), ("st3", "p_sum", 0, 2, "error"), ("st3", "p_tc", 0, 2, "error"), ("st3", "p_cls", 0, 2, "error"), ("st3", "p_bad", 0, 2, "syntax_error"),
    ("st3", "p_loop", 0, 2, "timeout"), ("st3", "p_div", 0, 2, "error"), ("st3", "p_exit", 0, 2, "ok"), ("st3", "p_fd", 0, 2, "error"), ("st3", "p_old", 0, 2, "error"), ("st3", "p_two", 2, 2, "ok"),
]


@query(f"SELECT * FROM ({_rows(_VERDICTS)}) AS v(query_id, doc_id, passed, total, first_status)")
def verify_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs run on the examples of two statements."""
    return sandbox.verify_pairs(_pairs(spark)).select("query_id", "doc_id", "passed", "total", "first_status")


@query("SELECT * FROM (VALUES ('st1', 'p_old', 1, 'PASSED 1/1 examples'), ('st1', 'p_sq', 2, 'PASSED 1/1 examples')) AS v(query_id, doc_id, final_rank, badge)")
def retrieve_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine as a whole: TF-IDF ranks programs for a statement, running them brings those that work to the top (of
    the two the old one shares more pairs of words with the statement)."""
    from tarn.plans.engine import Engine

    found = Engine(spark, alpha=3.0).index(_programs(spark).withColumnRenamed("code", "text")).retrieve({"st1": "n int input print n * n\n" + STATEMENTS[0][1]}, 2)
    return found.select("query_id", "doc_id", "final_rank", "badge")


OUTPUTS = [("q", 1, "ok", "7  8\n", None, "ok", "x\n", None), ("q", 2, "ok", "7 8", None, "timeout", "", None), ("q", 3, "error", "", "ValueError: bad", "timeout_skipped", "", "skipped")]


def _outputs(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(OUTPUTS, "query_id string, idx int, s1 string, o1 string, e1 string, s2 string, o2 string, e2 string")
    two = [versions.output_token(F.col(f"s{i}"), F.col(f"o{i}"), F.col(f"e{i}")) for i in (1, 2)]
    return rows.select("query_id", "idx", F.array(*two).alias("outputs"))


_TOKENS_SQL = rf"""WITH r AS (SELECT * FROM ({_rows(OUTPUTS)}) AS v(query_id, idx, s1, o1, e1, s2, o2, e2)), t AS (SELECT query_id, idx,
  {", ".join(rf"CASE WHEN s{i} IN ('timeout', 'timeout_skipped') THEN 'TIMEOUT' WHEN s{i} IN ('error', 'syntax_error') THEN 'CRASH:' || trim(string_split(coalesce(e{i}, 'error'), ':')[1]) ELSE trim(regexp_replace(o{i}, '\s+', ' ', 'g')) END AS t{i}" for i in (1, 2))} FROM r)
"""


@query(_TOKENS_SQL + "SELECT idx, sha256(t1 || chr(30) || t2) AS digest, (CASE WHEN starts_with(t1, 'CRASH:') THEN 1 ELSE 0 END) + (CASE WHEN starts_with(t2, 'CRASH:') THEN 1 ELSE 0 END) AS n_crashes, (CASE WHEN t1 = 'TIMEOUT' THEN 1 ELSE 0 END) + (CASE WHEN t2 = 'TIMEOUT' THEN 1 ELSE 0 END) AS n_timeouts FROM t")
def fingerprint_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("outputs")
    return _outputs(spark).select("idx", versions.digest(o).alias("digest"), versions.crashes(o).alias("n_crashes"), versions.timeouts(o).alias("n_timeouts"))


@query(_TOKENS_SQL + "SELECT a.idx AS a, b.idx AS b, ((CASE WHEN a.t1 = b.t1 THEN 1 ELSE 0 END) + (CASE WHEN a.t2 = b.t2 THEN 1 ELSE 0 END)) / 2.0::DOUBLE AS agreement FROM t a JOIN t b ON a.idx < b.idx")
def fingerprint_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _outputs(spark)
    pairs = o.select(F.col("idx").alias("a"), F.col("outputs").alias("x")).join(o.select(F.col("idx").alias("b"), F.col("outputs").alias("y")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", versions.agreement(F.col("x"), F.col("y")).alias("agreement"))


@query(_TOKENS_SQL + "SELECT a.idx, round(avg(((CASE WHEN a.t1 = b.t1 THEN 1 ELSE 0 END) + (CASE WHEN a.t2 = b.t2 THEN 1 ELSE 0 END)) / 2.0::DOUBLE), 5) AS consensus FROM t a JOIN t b ON a.idx <> b.idx GROUP BY a.idx")
def version_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.with_consensus(_outputs(spark)).select("idx", F.round("consensus", 5).alias("consensus"))


_SUM = "n = int(input())\nfor _ in range(n):\n    a, b = map(int, input().split())\n    print({})"
VERSIONS = [("q", 1, _SUM.format("a - b if a >= 7 else a + b")), ("q", 2, _SUM.format("a + b")), ("q", 3, _SUM.format("b + a") + "  # same"), ("q", 4, _SUM.format("a * b"))]
PAIR_SUM = "Sum of each pair.\n-----Sample Input-----\n3\n1 2\n3 4\n5 6\n-----Sample Output-----\n3\n7\n11\n"


@query("SELECT * FROM (VALUES (3, 1, 1, true), (2, 2, 1, false), (1, 3, 1, false), (4, 4, 0, false)) AS v(idx, rank, passed, unchanged)")
def rank_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a program, run and ranked: a bug that the example doesn't show is outvoted, the broken one is last."""
    v = spark.createDataFrame(VERSIONS, "query_id string, idx int, code string")
    q = examples.with_examples(spark.createDataFrame([("q", PAIR_SUM)], "query_id string, text string"))
    pairs = v.join(F.broadcast(q), "query_id").select("query_id", F.col("idx").cast("string").alias("doc_id"), "code", "examples", F.lit(False).alias("any_order"))
    verdicts = sandbox.verify_pairs(pairs).select("query_id", F.col("doc_id").cast("int").alias("idx"), "passed", "total")
    prints = versions.fingerprint_programs(v.join(F.broadcast(q.select("query_id", F.get("examples", F.lit(0))["stdin"].alias("stdin"))), "query_id"))
    rows = prints.join(verdicts, ["query_id", "idx"]).withColumns({"trace": F.lit(0.0), "blended": F.lit(0.5)})
    return versions.ranked(versions.with_consensus(versions.inherited(rows))).select("idx", "rank", "passed", "unchanged")


_DIFFS = [(1, "a = 1\nb = 2", "a = 1\nb = 3"), (2, "a\nb", "a"), (3, "", "x\n\ny")]


@query("SELECT * FROM (VALUES (1, 'b = 3', 'b = 2'), (2, '', 'b'), (3, 'x|y', '')) AS v(id, added, removed)")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame(_DIFFS, "id int, a string, b string").withColumn("d", versions.diff_lines(F.col("a"), F.col("b")))
    return d.select("id", F.array_join("d.added", "|").alias("added"), F.array_join("d.removed", "|").alias("removed"))


@query("SELECT * FROM (VALUES (1, round(1.0::DOUBLE / 3, 5)), (2, 0.0::DOUBLE)) AS v(id, overlap)")
def trace_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "45 then 998244353 then 77777", ["45", "7"]), (2, "1", ["1"])], "id int, t string, v array<string>")
    numbers = F.filter(statement_numbers(F.col("t"), 2), lambda x: x != "77777")
    return rows.select("id", F.round(versions.trace_overlap(numbers, F.col("v")), 5).alias("overlap"))


_CONTENT = [(1, "def f(x):\n    # note\n    return x+1"), (2, 'def f(x):\n    "doc"\n    return  x + 1'), (3, "def f(x):\n    return x+2"), (4, "print x  # py2\n"), (5, "print x")]


@query("SELECT * FROM (VALUES (1, 1, 'ast'), (2, 1, 'ast'), (3, 3, 'ast'), (4, 4, 'text'), (5, 4, 'text')) AS v(id, same_as, method)")
def snippet_ast_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs with the same content id, by the first that has it: ids of trees depend on the Python version."""
    s = store.with_content_id(spark.createDataFrame(_CONTENT, "id int, code string"))
    first = s.groupBy("sid").agg(F.min("id").alias("same_as"))
    return s.join(first, "sid").select("id", "same_as", "method")


_RUNS = [("codeforces", "train", 40, 50), ("leetcode", "train", 30, 60), ("dashed_sample", "test", 45, 50)]


@query(f"WITH r(f, kind, ok, n) AS ({_rows(_RUNS)}), s AS (SELECT n::DOUBLE / sum(n) OVER () AS share, ok::DOUBLE / n AS rate FROM r), p AS (SELECT round(sum(share * rate), 6) AS projected FROM s) SELECT projected, CASE WHEN projected >= 0.6 THEN 'PROCEED' WHEN projected >= 0.4 THEN 'FIX_FIRST' ELSE 'STOP' END AS decision FROM p")
def goldrun_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.createDataFrame([(f, k, i < ok) for f, k, ok, n in _RUNS for i in range(n)], "source_format string, kind string, passed boolean")
    counts = metrics.outcome_counts(runs)
    total = counts.agg(F.sum("n").alias("total"))
    return metrics.projection(counts.crossJoin(total).select("source_format", (F.col("n") / F.col("total")).alias("share"), (F.col("passed") / F.col("n")).alias("rate")))


_OUTCOMES = [("dashed_sample", "PASS", 1), ("leetcode", "wrong_output", 1), ("none", "no_examples", 1)]


@query(f"SELECT source_format, kind, CAST(n AS BIGINT) AS n FROM ({_rows(_OUTCOMES)}) AS v(source_format, kind, n)")
def gold_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs run on the examples of their statements, outcomes by layout."""
    gold = spark.createDataFrame([("st1", CODE_OF["p_sq"]), ("st3", CODE_OF["p_exit"]), ("st5", CODE_OF["p_sq"])], "query_id string, code string")
    s = examples.with_examples(_statements(spark)).join(F.broadcast(gold), "query_id")
    v = sandbox.verify_pairs(s.select("query_id", F.col("query_id").alias("doc_id"), "code", "examples", F.lit(False).alias("any_order")))
    return benchmark.gold_run(v, s)


_ROLES = [
    ("a", 1, 1, "x", 1, 1, 0.5, "good"), ("a", 2, 2, "x", 1, 1, 0.5, "cosmetic"), ("a", 3, 3, "y", 1, 1, 0.9, "faulty"),
    ("b", 1, 3, "z", 1, 1, 0.5, "good"), ("b", 2, 2, "q", 0, 1, 0.4, "cosmetic"), ("b", 3, 1, "z", 0, 1, 0.3, "faulty"),
]


@query(f"""WITH v AS (SELECT * FROM ({_rows(_ROLES)}) AS r(q, idx, rank, digest, passed, total, blended, role)), e AS (SELECT q, max(digest) FILTER (role = 'good') AS g, max(digest) FILTER (role = 'cosmetic') AS c, max(digest) FILTER (role = 'faulty') AS f,
  bool_or(passed = total) FILTER (role = 'faulty') AS both_pass, arg_min(role <> 'faulty', rank) AS first, arg_max(role <> 'faulty', blended * 1000 + idx) AS sim, arg_max(role <> 'faulty', idx) AS age FROM v GROUP BY q)
SELECT count(*) AS n, round(avg(CAST(g = c AS DOUBLE)), 5) AS certified_unchanged, round(avg(CAST(g <> f AS DOUBLE)), 5) AS fault_differs, round(avg(CAST(first AS DOUBLE)), 5) AS working_first,
  round(avg(CAST(first AS DOUBLE)) FILTER (both_pass), 5) AS working_first_both_pass, round(avg(CAST(sim AS DOUBLE)), 5) AS similarity_only, round(avg(CAST(age AS DOUBLE)), 5) AS newest_first FROM e""")
def version_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.version_rates(spark.createDataFrame(_ROLES, "query_id string, idx int, rank int, digest string, passed int, total int, blended double, role string"))


_RUNGS = [("r0", None, 0.56825), ("r1", "r0", None), ("r2", "r0", 0.87122), ("r3", "r2", 0.88224), ("r4", "r3", 0.88741)]


@query(f"WITH r(rung, base, score) AS ({_rows(_RUNGS)}) SELECT r.rung, r.base, CAST(r.score AS DOUBLE) AS score, round(CAST(r.score AS DOUBLE) - CAST(b.score AS DOUBLE), 5) AS delta, CASE WHEN r.score IS NULL THEN 'not run' ELSE 'run' END AS state FROM r LEFT JOIN r b ON r.base = b.rung")
def ablation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.deltas(spark.createDataFrame(_RUNGS, "rung string, base string, score double"))


def _result(**changed: object) -> str:
    row = {m: 0.5 for m in metrics.METRICS} | {"hf_subset": "default", "languages": ["eng-Latn"]} | changed
    return json.dumps({"dataset_revision": "1", "task_name": "t", "mteb_version": "1", "evaluation_time": 1.0, "scores": {"test": [row]}})


_JSON = [(1, _result()), (2, _result(ndcg_at_10=1.5)), (3, json.dumps({"task_name": "t", "test": {"ndcg_at_10": 0.5}})), (4, _result(languages=None))]


@query("SELECT * FROM (VALUES (1, ''), (2, 'ndcg_at_10 out of range'), (3, 'missing dataset_revision|missing mteb_version|missing evaluation_time|missing scores|missing scores.test'), (4, 'missing languages')) AS v(id, errors)")
def validate_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_JSON, "id int, j string").select("id", F.array_join(metrics.result_errors(F.col("j")), "|").alias("errors"))


@query("SELECT * FROM (VALUES (0, 5, 1, 0.0), (2, 0, 1, 0.0), (2, 2, 1, 1.0), (1, 2, 1, 0.5), (2, 2, 3, 0.386853), (2, 2, 64, 0.142857)) AS v(passed, total, m, conf)".replace("0.0)", "0.0::DOUBLE)").replace("1.0)", "1.0::DOUBLE)").replace("0.5)", "0.5::DOUBLE)").replace("0.386853)", "0.386853::DOUBLE)").replace("0.142857)", "0.142857::DOUBLE)"))
def rarity_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(0, 5, 1), (2, 0, 1), (2, 2, 1), (1, 2, 1), (2, 2, 3), (2, 2, 64)], "passed int, total int, m int")
    return rows.withColumn("conf", F.round(rerank.rarity_confidence(F.col("passed"), F.col("total"), F.col("m")), 6))
