"""URL filters: a trie over reversed host labels and path segments, broadcast, longest match first.

A rule is (host, path, verdict). It fits its host and all subdomains if the url's path starts with the rule's path.
The trie is walked from the last host label inwards; each host node that rules end in holds a second trie over the
path's segments. Of the fitting rules the one on the deepest host wins, and on one host the longest path.

The rules are broadcast once their trie is known to be within RULE_BYTES, counting NODE_BYTES for each label and segment
and each rule's own bytes; a larger list is refused with a message instead of being shipped to every executor.

Defined cases: a null url, or one without `://`, has an empty host and path and fits no rule; of rules with equal host
and path the last one counts; a host is compared as it stands, port and user included; an empty path fits only rules
with an empty path.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import map_texts, table

RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
RULE_BYTES, NODE_BYTES = 256 << 20, 600

_UPPER = str.maketrans({c: c + 32 for c in range(65, 91)})


class _Node:
    __slots__ = ("children", "end", "lengths", "open")

    def __init__(self) -> None:
        self.children: dict[str, _Node] = {}
        self.end = None  # of a host: the trie of its paths; of a path: the rule
        self.open: dict[str, tuple] = {}  # last segments that need not be whole
        self.lengths: list[int] = []  # theirs, the longest first


def segments(path: str) -> list[str]:
    """The path cut after each slash: `/en/7` gives `/`, `en/`, `7`."""
    parts = path.split("/")
    return [x + "/" for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


class RuleTrie:
    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.root = _Node()
        opened: dict[int, _Node] = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.translate(_UPPER).split(".")):
                node = node.children.setdefault(label, _Node())
            if node.end is None:
                node.end = _Node()
            at, rule = node.end, (host + path, verdict)
            for part in segments(path):
                if part.endswith("/"):
                    at = at.children.setdefault(part, _Node())
                else:
                    at.open[part] = rule
                    opened[id(at)] = at
                    break
            else:
                at.end = rule
        for node in opened.values():
            node.lengths = sorted({len(x) for x in node.open}, reverse=True)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule and verdict of the longest match."""
        found, node, parts = None, self.root, segments(path)
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            if node.end is not None:
                found = self._path(node.end, parts) or found
        return found

    @staticmethod
    def _path(at: _Node, parts: list[str]) -> tuple[str, str] | None:
        found = at.end
        for part in parts:
            found = next((at.open[part[:n]] for n in at.lengths if part[:n] in at.open), found)
            at = at.children.get(part)
            if at is None:
                break
            found = at.end or found
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """Per page: host, path, the rule that decides (or null) and the verdict; default where no rule fits."""
    if sum(len(f"{h}{p}{v}".encode()) + NODE_BYTES * (2 + h.count(".") + p.count("/")) for h, p, v in rules) > RULE_BYTES:
        raise ValueError(f"the rules exceed {RULE_BYTES} bytes; split the list by top-level label and filter in turns")
    shared = pages.sparkSession.sparkContext.broadcast(RuleTrie(list(rules)))

    def judge(batch: pa.RecordBatch) -> dict:
        trie, seen = shared.value, [split_url(u) for u in batch.column("url").to_pylist()]
        found = [trie.match(*x) for x in seen]
        return {
            "key": batch.column("key"),
            "host": [x[0] for x in seen],
            "path": [x[1] for x in seen],
            "rule": [x and x[0] for x in found],
            "verdict": [x[1] if x else default for x in found],
        }

    kind = dict(pages.dtypes)[key]
    out = map_texts(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), ["key", "url"], judge, f"key {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("key", key)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the four rules of RULES."""
    return filter_urls(table(spark, sf_dir, "pages"), list(RULES))


ORACLE_SQL = r"""
WITH s AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), c AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM s), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM c
), rules(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost) * 100000 + length(rpath)) AS rule,
    arg_max(verdict, length(rhost) * 100000 + length(rpath)) AS verdict
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id)
"""
