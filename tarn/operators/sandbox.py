"""Runs candidate programs on worked examples, resource-limited but not isolated from network or file system.

Each run is a child process with limits on wall clock, CPU seconds, memory and file size, in a temporary folder with an
empty environment. Each Python worker keeps one process that has the usual modules loaded and forks a child for each run. Verification is a mapInPandas over pairs of query and program. Pairs are dealt by a program's code and
a number, so a program that many queries ask for is spread over tasks; within a task a program's pairs follow one another
in a fixed order, and it gets less time after two timeouts and none after four, whatever ids it goes by.

Defined cases: a pair without examples has no run and a null status; a null program doesn't parse; repeated pairs are run
each on its own; outputs beyond a megabyte are cut; empty tables give no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import signal
import subprocess
import sys
import tempfile
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.compare import compare
from tarn.operators.programs import entry_point, runnable

SECONDS, REDUCED, REDUCE_AT, SKIP_AT = 0.75, 0.30, 2, 4
MEMORY_MB, CAPTURED, FILE_BYTES = 1024, 1 << 20, 32 << 20


@dataclass(frozen=True)
class Run:
    """What came of a run. status: ok, empty_output, error, timeout, timeout_skipped or syntax_error."""

    status: str
    stdout: str = ""
    error: str | None = None
    mode: str = "none"
    matched: bool = False
    runtime_ms: float = 0.0
    values: tuple[str, ...] | None = None


@functools.lru_cache(maxsize=4096)
def _prepared(code: str) -> tuple[str | None, str | None, dict | None]:
    source, error = runnable(code)
    return source, error, entry_point(source) if source is not None else None


_server: list[subprocess.Popen] = []


def _ask(job: dict) -> dict:
    """The answer of this worker's forking process, which is started when there is none; one that has died is replaced once."""
    request = (json.dumps(job) + "\n").encode()
    for attempt in (0, 1):
        if not _server or _server[0].poll() is not None:
            path = os.path.join(os.path.dirname(os.path.abspath(__file__)), "child.py")
            env = {"PYTHONIOENCODING": "utf-8", "PYTHONHASHSEED": "0"}
            _server[:] = [subprocess.Popen([sys.executable, "-I", "-S", path], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env)]
        try:
            _server[0].stdin.write(request)
            _server[0].stdin.flush()
            if line := _server[0].stdout.readline():
                return json.loads(line)
        except (BrokenPipeError, OSError):
            if attempt:
                raise
        _server[0].kill()
        _server[0].wait()
    raise RuntimeError("the process that runs programs ended twice")


def run(code: str, stdin: str, expected: str | None = None, any_order: bool = False, seconds: float = SECONDS, trace: bool = False, memory_mb: int = MEMORY_MB) -> Run:
    """One run of a program; with an expected output, whether that came."""
    source, error, entry = _prepared(code)
    if source is None:
        return Run("syntax_error", error=error)
    with tempfile.TemporaryDirectory(prefix="tarn-run-") as folder:
        at = lambda name: os.path.join(folder, name)
        with open(at("in"), "w", encoding="utf-8", errors="replace") as f:
            f.write(stdin)
        os.mkdir(at("cwd"))
        job = {
            "code": source, "stdin": stdin, "entry": entry, "trace": trace, "memory": memory_mb << 20, "cpu": int(seconds) + 1, "file": FILE_BYTES, "seconds": seconds,
            "in": at("in"), "stdout": at("out"), "cwd": at("cwd"), "out": at("result"),
        }
        began = time.monotonic()
        ended = _ask(job)
        took = (time.monotonic() - began) * 1000
        try:
            with open(at("out"), "rb") as f:
                stdout = f.read(CAPTURED).decode("utf-8", "replace")
        except FileNotFoundError:
            stdout = ""
        if ended["late"] or ended["signal"] == signal.SIGXCPU:
            return Run("timeout", stdout, "timeout", "script", runtime_ms=took)
        try:
            with open(at("result")) as f:
                said = json.load(f)
        except (OSError, ValueError):
            said = {"mode": "script", "error": f"ended by signal {ended['signal']}", "values": None}
    values = tuple(said["values"]) if said["values"] is not None else None
    if said["error"] is not None:
        return Run("error", stdout, said["error"], said["mode"], runtime_ms=took, values=values)
    if not stdout.strip():
        return Run("empty_output", stdout, None, said["mode"], runtime_ms=took, values=values)
    matched = expected is not None and compare(stdout, expected, any_order)[0]
    return Run("ok", stdout, None, said["mode"], matched, took, values)


class Patience:
    """Time a program still gets, by how often it has run out of it."""

    def __init__(self) -> None:
        self.late: dict[str, int] = {}

    def run(self, code: str, stdin: str, expected: str | None = None, any_order: bool = False) -> Run:
        key = hashlib.md5((_prepared(code)[0] or code).encode("utf-8", "ignore")).hexdigest()
        n = self.late.get(key, 0)
        if n >= SKIP_AT:
            return Run("timeout_skipped", error="skipped after repeated timeouts")
        done = run(code, stdin, expected, any_order, REDUCED if n >= REDUCE_AT else SECONDS)
        self.late[key] = n + (done.status == "timeout")
        return done


def verify(code: str, examples: list[tuple[str, str]], any_order: bool, patience: Patience) -> list[Run]:
    """Runs on one example after the other, until one breaks. A mismatch on an input with blank lines is tried once
    more without them."""
    runs: list[Run] = []
    for stdin, expected in examples:
        done = patience.run(code, stdin, expected, any_order)
        if not done.matched and done.status not in ("timeout_skipped", "syntax_error") and "\n\n" in stdin.strip("\n"):
            again = patience.run(code, "".join(x + "\n" for x in stdin.split("\n") if x.strip()), expected, any_order)
            if again.matched or again.status == "ok" and done.status in ("error", "empty_output"):
                done = again
        runs.append(done)
        if not done.matched and done.status not in ("ok", "empty_output"):
            break
    return runs


VERDICT = "passed int, total int, first_status string, failure string, first_output string, statuses array<string>, runtime_ms double"


def verify_pairs(pairs: DataFrame, salts: int = 8) -> DataFrame:
    """Pairs (query_id, doc_id, code, examples, any_order) with their verdicts; code and examples are dropped."""
    kinds = dict(pairs.dtypes)
    dealt = pairs.withColumn("_code", F.md5("code")).withColumn("_salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)))
    n = max(8, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(n, "_code", "_salt").sortWithinPartitions("_code", "query_id")

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patience, last = Patience(), None
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                if r.code != last:
                    patience, last = (Patience(), r.code)
                examples = [(e["stdin"], e["expected"]) for e in r.examples] if r.examples is not None else []
                runs = verify(r.code or "", examples, bool(r.any_order), patience) if examples else []
                rows.append((r.query_id, r.doc_id, sum(x.matched for x in runs), len(examples), runs[0].status if runs else None, next(("wrong_output" if x.status == "ok" else x.status for x in runs if not x.matched), None), runs[0].stdout.strip() if runs else "", [x.status for x in runs], sum(x.runtime_ms for x in runs)))
            yield pd.DataFrame(rows, columns=["query_id", "doc_id", "passed", "total", "first_status", "failure", "first_output", "statuses", "runtime_ms"])

    kept = dealt.select("query_id", "doc_id", "code", "examples", "any_order")
    return kept.mapInPandas(judge, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, {VERDICT}")
