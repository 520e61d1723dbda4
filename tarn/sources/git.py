"""A data source for the history of a git repository: what each commit changes.

The driver lists commits; a partition reads the changes of a run of commits, so a long history is read in parallel. A
commit's changes are those against the one before it in the list, which after a merge need not be its parent: so what
all changes come to is each commit's own listing. The repository's folder must be reachable under the same path by every
executor.

Defined cases: bytes that aren't UTF-8 become replacement characters; hidden files and folders and other suffixes are left
out; a repository without commits gives no rows.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "snapshot_index int, ref string, ts double, path string, status string, code string"
COMMITS = 50


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], check=True, capture_output=True).stdout


def commits(repo: str, most: int | None = None) -> list[tuple[str, float]]:
    """(hash, time), the oldest first; with a bound the last ones."""
    lines = _git(repo, "log", "--reverse", "--format=%H %ct").decode().split("\n")
    found = [(h, float(t)) for h, _, t in (x.partition(" ") for x in lines if x)]
    return found if most is None else found[-most:]


class Commits(InputPartition):
    """A run of commits, and the one before it in the list."""

    def __init__(self, start: int, refs: list[tuple[str, float]], before: str | None) -> None:
        self.start, self.refs, self.before = start, refs, before


class GitReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.suffix = options["path"], options.get("suffix", ".py")
        self.most = int(options["maxcommits"]) if options.get("maxcommits") else None

    def partitions(self) -> list[Commits]:
        refs = commits(self.repo, self.most)
        return [Commits(i, refs[i : i + COMMITS], refs[i - 1][0] if i else None) for i in range(0, len(refs), COMMITS)] or [Commits(0, [], None)]

    def _is_code(self, path: str) -> bool:
        return path.endswith(self.suffix) and not any(p.startswith(".") for p in path.split("/"))

    def read(self, partition: Commits) -> Iterator[tuple]:
        before = partition.before
        for index, (ref, ts) in enumerate(partition.refs, partition.start):
            if before is None:  # a full listing, whatever came before
                names = _git(self.repo, "ls-tree", "-r", "-z", "--name-only", ref).decode("utf-8", "replace").split("\0")
                changes = [("A", n) for n in names if n]
            else:
                raw = _git(self.repo, "diff-tree", "-r", "-z", "--no-renames", "--no-commit-id", "--name-status", before, ref).decode("utf-8", "replace").split("\0")
                changes = list(zip(raw[0::2], raw[1::2], strict=False))
            before = ref
            for status, path in changes:
                if self._is_code(path):
                    code = None if status == "D" else _git(self.repo, "show", f"{ref}:{path}").decode("utf-8", "replace")
                    yield index, ref, ts, path, status, code


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarn_git"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> GitReader:
        return GitReader(self.options)


def git_changes(spark: SparkSession, repo: str, most: int | None = None) -> DataFrame:
    spark.dataSource.register(GitHistory)
    reader = spark.read.format("tarn_git").option("path", repo)
    return (reader.option("maxcommits", str(most)) if most else reader).load()
