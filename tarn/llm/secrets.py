"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is parsed on the driver into a Boolean trigram query: an OR of conjunctions of trigrams
that any match must contain (letters lower-cased). The index holds postings (trigram, document), taken from the texts'
own trigrams in one pass, for the trigrams that some query asks for. A document is a candidate for a rule if, for one of
the rule's conjunctions, it is in the postings of every trigram. Only candidates' texts meet the index and are verified
with the regular expression itself; their spans go back to all documents by key, so that no other text ever travels. A
rule without mandatory trigrams (the hex rule) scans every text where it is read.

Positions come from the matches and the pieces between them, whose lengths add up to the offsets, in code points.

Defined cases: a null or empty text has no spans; rows with the same id and text share an entry of the index and its
spans, and are all returned; a null id is indexed like any other.
"""

from __future__ import annotations

import itertools
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import table

#: Exact strings a part of an expression may have before it counts as open.
EXACT = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of regex stand if group has at least `least` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # runs of 32 and more are the matches of [0-9a-f]+ with 32 characters: both are whole runs
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 60),
    Rule("github", r"gh[opusr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
)


# --- Boolean trigram queries ------------------------------------------------------------------------------------------

Query = frozenset  # of conjunctions, each a frozenset of trigrams; {frozenset()} says nothing, so everything is scanned
ANY: Query = frozenset([frozenset()])


def _and(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x in a for y in b))


def _least(q: Query) -> Query:
    """Without conjunctions that another one implies."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _of(strings: frozenset[str]) -> Query:
    """What any of these strings must contain."""
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)) if strings else ANY


class _Reader:
    """Reads a regular expression. Of each part: all its exact strings, if they are few (else None), and a query that
    every match satisfies. What it doesn't know counts as any text, which is safe."""

    CLASSES = {"d": string.digits, "n": "\n", "t": "\t", "r": "\r"}

    def __init__(self, regex: str) -> None:
        self.regex, self.at = regex, 0

    def _next(self, text: str) -> bool:
        if self.regex.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def _char(self) -> str:
        self.at += 1
        return self.regex[self.at - 1]

    def whole(self) -> Query:
        exact, query = self.alternatives()
        if self.at < len(self.regex):
            raise ValueError(f"unbalanced expression: {self.regex}")
        query = _of(exact) if exact is not None else query
        return ANY if frozenset() in query else query

    def alternatives(self) -> tuple[frozenset[str] | None, Query]:
        parts = [self.sequence()]
        while self._next("|"):
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        strings = frozenset().union(*[e for e, _ in parts]) if all(e is not None for e, _ in parts) else None
        query = _least(frozenset().union(*[q for _, q in parts]))
        return (strings if strings is not None and len(strings) <= EXACT else None), query

    def sequence(self) -> tuple[frozenset[str] | None, Query]:
        run, query, whole = frozenset([""]), ANY, True
        while self.at < len(self.regex) and self.regex[self.at] not in "|)":
            exact, inner = self.repeated()
            if exact is not None and len(run) * len(exact) <= EXACT:
                run = frozenset(a + b for a in run for b in exact)
            else:
                query, whole = _and(_and(query, _of(run)), inner), False
                run = exact if exact is not None else frozenset([""])
        return (run if whole else None), _and(query, _of(run))

    def repeated(self) -> tuple[frozenset[str] | None, Query]:
        exact, query = self.atom()
        low, high = 1, 1
        if self._next("*"):
            low, high = 0, None
        elif self._next("+"):
            high = None
        elif self._next("?"):
            low = 0
        elif self._next("{"):
            bounds = ""
            while not self._next("}"):
                bounds += self._char()
            first, comma, last = bounds.partition(",")
            low = int(first or 0)
            high = (int(last) if last else None) if comma else low
        else:
            return exact, query
        _ = self._next("?") or self._next("+")  # lazy or possessive: the same strings at most
        if low == 0:
            return (exact | {""}, ANY) if high == 1 and exact is not None else (None, ANY)
        return (exact, query) if low == high == 1 else (None, query if exact is None else _of(exact))

    def atom(self) -> tuple[frozenset[str] | None, Query]:
        c = self._char()
        if c == "(":
            if self._next("?"):
                flags = ""
                while self.regex[self.at] not in ":)":
                    flags += self._char()
                if flags.strip(string.ascii_letters + "-"):  # looks ahead or behind, or names itself
                    raise ValueError(f"only plain groups and flags are known: {self.regex}")
                if self._char() == ")":
                    return frozenset([""]), ANY
            found = self.alternatives()
            if not self._next(")"):
                raise ValueError(f"unbalanced expression: {self.regex}")
            return found
        if c == "[":
            return self._few(self.members())
        if c in "^$":
            return frozenset([""]), ANY
        if c == ".":
            return None, ANY
        return self._few(self.escaped()) if c == "\\" else (frozenset([c.lower()]), ANY)

    def escaped(self) -> str | None:
        """The characters that an escape stands for; None if they are many."""
        c = self._char()
        if c == "x":
            self.at += 2
            return chr(int(self.regex[self.at - 2 : self.at], 16))
        if c in string.ascii_letters + string.digits:
            return "" if c in "bBAzZ" else self.CLASSES.get(c)
        return c

    def members(self) -> str | None:
        """The characters of a class, whose first one may be a closing bracket; None if they are many."""
        negated, chars, many, first = self._next("^"), "", False, True
        while first or not self._next("]"):
            first = False
            c = self._char()
            one = self.escaped() if c == "\\" else c
            if one and self.regex.startswith("-", self.at) and self.regex[self.at + 1] != "]":
                self.at += 1
                last = self._char()
                last = self.escaped() if last == "\\" else last
                one = "".join(map(chr, range(ord(one), ord(last) + 1)))
            many |= one is None
            chars += one or ""
        return None if negated or many else chars

    @staticmethod
    def _few(chars: str | None) -> tuple[frozenset[str] | None, Query]:
        if chars == "":
            return frozenset([""]), ANY
        low = None if chars is None else frozenset(chars.lower())
        return (low if low is not None and len(low) <= 8 else None), ANY


def trigram_query(regex: str) -> Query:
    """An OR of conjunctions of trigrams; the empty conjunction means that every text must be scanned."""
    return _Reader(regex).whole()


# --- index and verification --------------------------------------------------------------------------------------------


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def own_trigrams(text: Column, trigrams: list[str]) -> Column:
    """Those of the trigrams that a text has, lower-cased: one pass of an expression that looks ahead at every place."""
    by_first = itertools.groupby(sorted(trigrams), key=lambda t: t[0])
    choices = "|".join(f"{_quoted(c)}(?:{'|'.join(_quoted(t[1:]) for t in of)})" for c, of in by_first)
    found = F.regexp_extract_all(text, F.lit(f"(?i)(?=({choices}))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.lower(t)))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key): the documents (_key) whose text has each of the trigrams asked for."""
    return docs.select("_key", F.explode(own_trigrams(F.col("text"), trigrams)).alias("trigram"))


def holds(own: Column, query: Query) -> Column:
    """Whether a document's trigrams satisfy a query."""
    every = lambda c: F.size(F.array_intersect(own, F.array(*map(F.lit, sorted(c))))) == len(c)
    flag = F.lit(False)
    for conjunction in query:
        flag = flag | every(conjunction)
    return flag


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, and a flag for each rule): the postings intersected.

    A document's postings are summed up as bits of each conjunction, on the map side first."""
    names, sums = [], []
    for kind, query in queries.items():
        for n, conjunction in enumerate(sorted(map(sorted, query))):
            bits = F.lit(None).cast("long")
            for i, t in enumerate(conjunction):
                bits = F.when(F.col("trigram") == t, F.lit(1 << i).cast("long")).otherwise(bits)
            names.append((kind, f"c_{kind}_{n}", (1 << len(conjunction)) - 1))
            sums.append(F.bit_or(bits).alias(names[-1][1]))
    found = index.groupBy("_key").agg(*sums)
    flags = []
    for kind in queries:
        flag = F.lit(False)
        for k, name, full in names:
            if k == kind:
                flag = flag | F.coalesce(F.col(name) == full, F.lit(False))
        flags.append(flag.alias(f"has_{kind}"))
    found = found.select("_key", *flags)
    return found.where(" OR ".join(f"has_{k}" for k in queries))


def located(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in a text: array of (start, order, end, kind)."""
    pattern = F.lit(rule.regex)
    matches, kept = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    lengths = lambda c: F.transform(c, lambda x: F.length(x))
    add = lambda a, n: a + n
    found = F.struct(lengths(F.split(text, rule.regex, -1)).alias("gaps"), lengths(matches).alias("sizes"), lengths(kept).alias("kept"))

    def placed(f: Column) -> Column:
        return F.transform(
            F.arrays_zip(f["sizes"].alias("n"), f["kept"].alias("g")),
            lambda z, i: F.struct(
                (F.aggregate(F.slice(f["gaps"], F.lit(1), i + 1), F.lit(0), add) + F.aggregate(F.slice(f["sizes"], F.lit(1), i), F.lit(0), add)).alias("start"),
                z["n"].alias("n"), z["g"].alias("g")),
        )

    # bound to a lambda's name, the lengths are worked out once and not for each match
    kept_spans = F.filter(F.get(F.transform(F.array(found), placed), F.lit(0)), lambda s: s["g"] >= rule.least)
    return F.transform(kept_spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), (s["start"] + s["n"]).alias("end"), F.lit(rule.kind).alias("kind")))


_SPAN = "array<struct<start:int,order:int,end:int,kind:string>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = (*BASE, *MORE), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans, (start, order, end, kind) by start and then rule, of every row."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("_key", F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h")))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) != ANY}
    none = F.array().cast(_SPAN)
    spans = lambda n, r, may: F.when(may, located(F.col("text"), r, n)).otherwise(none)
    scanned = [spans(n, r, F.col("text").rlike(r.regex)) for n, r in enumerate(rules) if r.kind not in queries]
    if not queries:
        return rows.select("doc_id", F.array_sort(F.concat(*scanned)).alias("spans"))
    trigrams = sorted(set(itertools.chain.from_iterable(itertools.chain.from_iterable(queries.values()))))
    flagged = candidates(postings(rows, trigrams), queries)
    likely = F.lit(False)
    for q in queries.values():
        likely = likely | holds(F.col("_own"), q)
    # a text goes to meet the index only if it can be a candidate at all
    texts = rows.withColumn("_own", own_trigrams(F.col("text"), trigrams)).where(likely).drop("_own")
    verified = texts.join(flagged, "_key").select("_key", F.concat(*[spans(n, r, F.col(f"has_{r.kind}")) for n, r in enumerate(rules) if r.kind in queries]).alias("_found"))
    verified = verified.groupBy("_key").agg(F.first("_found").alias("_found"))
    own = rows.select("doc_id", "_key", (F.concat(*scanned) if scanned else none).alias("_scanned"))
    return own.join(verified, "_key", "left").select("doc_id", F.array_sort(F.concat("_scanned", F.coalesce("_found", none))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """Each rule's matches and the pieces between them, whose lengths add up; with no index."""
    parts = []
    for n, r in enumerate((*BASE, *MORE)):
        regex = r.regex.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {n} AS o, '{r.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, g, p FROM (SELECT doc_id, regexp_extract_all(text, '{regex}', 0) AS m, "
            f"regexp_extract_all(text, '{regex}', {r.group}) AS g, string_split_regex(text, '{regex}') AS p FROM d WHERE regexp_matches(text, '{regex}'))"
        )
    least = " ".join(f"WHEN {n} THEN {r.least}" for n, r in enumerate((*BASE, *MORE)))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({" UNION ALL ".join(parts)}), s AS (
  SELECT doc_id, o, kind, list_sum(list_transform(p[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n
  FROM f WHERE length(g[i]) >= CASE o {least} END
), t AS (SELECT doc_id, o, kind, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS t FROM s), a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(t, ',' ORDER BY s, o) FILTER (o < {len(BASE)}), '') AS base, string_agg(t, ',' ORDER BY s, o) AS spans FROM t GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""


ORACLE_SQL = _oracle()
