"""Personal data by weak supervision.

Every whole text gives base spans (exact patterns with their checks) and candidates, spans of looser patterns of the
same kinds and of kinds of their own. Labelers vote on each candidate, for, against or not at all: regex labelers
(format and check digits), gazetteer labelers (top-level domains, calling codes, card prefixes, reserved values) and
context labelers (words before the span, what surrounds it). A candidate is reduced to its votes and to coarse features
of the span that no labeler looks at; how often each such pattern occurs over all documents is the only thing gathered,
at most 6 kinds times 3^6 votes times 108 features, whatever the input. Expectation-maximisation over the votes estimates
each labeler's reliability without labels, from the belief that one candidate in ten is personal data; its posteriors
train the span classifier, a logistic regression on votes and features, which alone decides each pattern.

Base spans always stay; a candidate that the classifier accepts is added unless it meets a base span or an earlier
added one.

Defined cases: a null or empty text has no spans; repeated rows are judged each on its own; with no candidates nothing
is added. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import ipaddress
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import _arrow_schema, checkpoint, on_all_cores, sha256, sliced, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: What is believed before: the accuracy of a labeler, the share of candidates that are personal data.
ACCURACY, SHARE = 0.8, 0.1

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# A match can't start inside a run of digits, so looking behind only spares tries.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")

_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[\[({<] ?(?:at|AT) ?[\])}>] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[({<] ?(?:dot|DOT) ?[\])}>] ?|\.)[A-Za-z0-9-]{1,63}){1,8}(?![A-Za-z0-9-])"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Fa-f:.])"),
    "card": re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,4}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\) ?|0[0-9]{1,4}[ /-]|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z])"),
    "ssn": re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
}

# Gazetteers
_TLDS = frozenset("com org net edu gov info io co de fr es uk it nl ch at be pl se eu us ca au jp in br ru".split())
_CONTEXT = {
    "email": "mail e-mail email contact write reach address",
    "ip": "ip ipv6 ipv4 host server address client login",
    "card": "card visa mastercard amex credit debit payment paid cc",
    "phone": "phone tel telephone call mobile cell fax dial sms whatsapp",
    "ssn": "ssn social security",
    "iban": "iban account bank transfer konto",
}
_WORDS = {k: re.compile(rf"(?<![A-Za-z])(?:{'|'.join(map(re.escape, v.split()))})(?![A-Za-z])", re.IGNORECASE) for k, v in _CONTEXT.items()}
_OTHER = re.compile(r"(?<![A-Za-z])(?:version|isbn|order|invoice|article|item|serial|id|no|nr|page|pages|section)[.:# ]*$", re.IGNORECASE)
LABELERS = ("format", "check", "gazetteer", "context", "neighbour", "shape")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches that pass their checks, by start and then kind."""
    out: list[tuple[str, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            out.append(("email", start, free))
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    out.sort(key=lambda x: (x[1], ORDER[x[0]], x[2]))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the looser patterns that meet no base span."""
    digits = _DIGIT.search(text) is not None
    out = []
    for kind, pattern in _LOOSE.items():
        if kind == "email" and "at" not in text and "AT" not in text or kind == "ip" and "::" not in text and text.count(":") < 2:
            continue
        if kind not in ("email", "ip") and not digits:
            continue
        if kind == "email" and not any(c in text for c in "[({<"):
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    if not out or not base:
        return out
    starts = [s for _, s, _ in base]
    ends = list(itertools.accumulate((e for _, _, e in base), max))  # of the spans so far, the furthest end
    return [c for c in out if not (i := bisect.bisect_left(starts, c[2])) or ends[i - 1] <= c[1]]


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote: 1 for, -1 against, 0 none."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 12]
    digits = _NOT_DIGIT.sub("", span)
    form = check = gazetteer = shape = 0
    if kind == "email":
        host = re.split(r"[\])}>]", re.sub(r" ?[\[({<] ?dot ?[\])}>] ?", ".", span, flags=re.IGNORECASE))[-1].strip()
        form = 1 if re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", host) else -1
        gazetteer = 1 if host.rpartition(".")[2].lower() in _TLDS else -1
        shape = 1 if span.count(" ") <= 4 else -1
    elif kind == "ip":
        try:
            address = ipaddress.IPv6Address(span)
            form, gazetteer = 1, -1 if address.is_unspecified or address.is_loopback else 1 if address.is_global or address.is_private else 0
        except ValueError:
            form = -1
        shape = 1 if len(span) > 8 and digits else -1
    elif kind == "card":
        form = 1 if 13 <= len(digits) <= 19 else -1
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
        shape = -1 if len(set(digits)) < 4 else 1
    elif kind == "phone":
        form = 1 if 9 <= len(digits) <= 12 else -1
        gazetteer = -1 if digits[:3] in ("000", "555", "911") else 0
        shape = -1 if len(set(digits)) < 3 else 1 if span[0] in "(0" else 0
    elif kind == "ssn":
        area, group, serial = span.split("-")
        form = -1 if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000" else 1
        shape = -1 if len(set(digits)) < 4 else 0
    else:
        code = span.replace(" ", "")
        form = 1 if 15 <= len(code) <= 34 else -1
        moved = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
        check = 1 if int(moved) % 97 == 1 else -1
        shape = 1 if sum(c.isdigit() for c in code) >= len(code) // 2 else -1
    context = 1 if _WORDS[kind].search(before) else -1 if _OTHER.search(before) else 0
    neighbour = -1 if before[-1:] in ("$", "€", "£", "#", "/") or after[:1] in ("%", "/") else 0
    return form, check, gazetteer, context, neighbour, shape


def features(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """What else there is of a span, in few steps: its length, the share of digits, kinds of separators, what it follows."""
    span = text[start:end]
    digits = sum(c in "0123456789" for c in span)
    separators = len({c for c in span if not c.isalnum()})
    before = text[start - 1 : start] if start else "\n"
    return min(2, len(span) // 16), 3 * digits // (len(span) + 1), min(3, separators), 2 if before in ":=\"'(<[" else 1 if before.isspace() else 0


Pattern = tuple[str, tuple[int, ...], tuple[int, ...]]


class SpanClassifier:
    """Labeler reliabilities by expectation-maximisation, and the classifier trained on their posteriors."""

    def __init__(self, counts: dict[Pattern, int], rounds: int = 50) -> None:
        """counts: of each kind, votes and features how many candidates have them."""
        self.reliability: dict[str, np.ndarray] = {}
        self.accepted: set[Pattern] = set()
        for kind in KINDS:
            patterns = sorted(p for p in counts if p[0] == kind)
            if patterns:
                x = np.array([p[1] for p in patterns], np.float64)
                n = np.array([counts[p] for p in patterns], np.float64)
                self.reliability[kind], posterior = self._em(x, n, rounds)
                p = self._logistic(x, np.array([p[2] for p in patterns], np.float64), n, posterior)
                self.accepted |= {pattern for pattern, q in zip(patterns, p, strict=True) if q >= 0.5}

    @staticmethod
    def _em(x: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Accuracy of each labeler where it votes, and the posterior of each pattern.

        Ten votes of the accuracy, and as many candidates of the share as there are, stand for what is believed before;
        accuracies stay over 0.5, which keeps the two classes from changing places."""
        accuracy, prior = np.full(x.shape[1], ACCURACY), SHARE
        cast, believed = np.abs(x), max(10.0, n.sum())
        for _ in range(rounds):
            odds = np.log(accuracy / (1 - accuracy))
            posterior = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + x @ odds)))
            right = (n[:, None] * np.where(x > 0, posterior[:, None], np.where(x < 0, 1 - posterior[:, None], 0))).sum(axis=0)
            accuracy = np.clip((right + 10 * ACCURACY) / ((n[:, None] * cast).sum(axis=0) + 10), 0.55, 0.99)
            prior = float(np.clip(((n * posterior).sum() + believed * SHARE) / (n.sum() + believed), 0.02, 0.98))
        return accuracy, posterior

    @staticmethod
    def _logistic(x: np.ndarray, more: np.ndarray, n: np.ndarray, target: np.ndarray, rounds: int = 30) -> np.ndarray:
        """Ridge logistic regression on votes for, votes against, their sum and the features, by Newton steps."""
        f = np.concatenate([x > 0, x < 0, x.sum(axis=1, keepdims=True), more, np.ones((len(x), 1))], axis=1).astype(np.float64)
        weights, w = n / n.sum() * len(n), np.zeros(f.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            gradient = f.T @ (weights * (p - target)) + 0.05 * w
            hessian = (f * (weights * p * (1 - p))[:, None]).T @ f + 0.05 * np.eye(len(w))
            w -= np.linalg.solve(hessian, gradient)
        return 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))


def _encode(kind: str, vote: tuple[int, ...], more: tuple[int, ...]) -> str:
    return f"{kind}:{''.join('-0+'[v + 1] for v in vote)}:{''.join(map(str, more))}"


def _decode(pattern: str) -> Pattern:
    kind, vote, more = pattern.split(":")
    return kind, tuple("-0+".index(c) - 1 for c in vote), tuple(map(int, more))


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str]]]:
    """Base spans, and candidates with their vote patterns."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, [(k, s, e, _encode(k, votes(text, k, s, e), features(text, k, s, e))) for k, s, e in candidates(text, base)]


def merged(base: list[tuple[str, int, int]], found: list[tuple[str, int, int, str]], accepted: set[str] | frozenset[str]) -> list[tuple[str, int, int]]:
    """Base spans and accepted candidates, by start and then kind."""
    out, end = list(base), -1
    for kind, s, e, pattern in sorted(found, key=lambda c: (c[1], -c[2], ORDER[c[0]])):
        if pattern in accepted and s >= end:
            out.append((kind, s, e))
            end = e
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def learn(patterns: DataFrame) -> frozenset[str]:
    """The patterns (column pattern, any number of rows) that the classifier accepts."""
    counts = {_decode(r["pattern"]): r["count"] for r in patterns.groupBy("pattern").count().collect()}
    return frozenset(_encode(*p) for p in SpanClassifier(counts).accepted)


_SPANS = "array<struct<kind:string,s:int,e:int,pattern:string>>"


def detect(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans (all) and added, the number of spans beyond the base ones."""
    schema = f"doc_id bigint, base {_SPANS}, found {_SPANS}"
    from pyspark.sql.types import _parse_datatype_string

    arrow = _arrow_schema(_parse_datatype_string(schema))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            both = [find(t) for t in batch.column(1).to_pylist()]
            base = [[{"kind": k, "s": s, "e": e, "pattern": None} for k, s, e in b] for b, _ in both]
            found = [[{"kind": k, "s": s, "e": e, "pattern": p} for k, s, e, p in f] for _, f in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, arrow.field(1).type), pa.array(found, arrow.field(2).type)], schema=arrow)

    spans = checkpoint(docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, schema))
    accepted = learn(spans.select(F.explode("found").alias("c")).select("c.pattern"))
    out = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    result = _arrow_schema(_parse_datatype_string(out))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc_id, b, f in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                base = [(x["kind"], x["s"], x["e"]) for x in b]
                spans = merged(base, [(x["kind"], x["s"], x["e"], x["pattern"]) for x in f], accepted)
                kinds = [x[0] for x in base]
                rows.append((doc_id, *[kinds.count(k) for k in BASE], sha256(joined(base).encode()), joined(spans), len(spans) - len(base)))
            columns = zip(*rows, strict=True) if rows else itertools.repeat([], len(result))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, result, strict=True)], schema=result)

    return spans.mapInArrow(decide, out)


def redacted(text: str | None, accepted: frozenset[str] | set[str]) -> str | None:
    """The text with each span (those that overlap: together) replaced by its kind in brackets."""
    if not text:
        return text
    out, end = [], 0
    for kind, s, e in merged(*find(text), accepted):
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with personal data replaced in their texts; a column n_chars, if there is one, is counted again."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [[c[3] for c in find(t)[1]] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p for f in found for p in f], pa.string())], names=["pattern"])

    accepted = learn(docs.select(text).mapInArrow(scan, "pattern string"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            new = [redacted(t, accepted) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            columns = [pa.array(new, f.type) if f.name == text else c for f, c in zip(batch.schema, batch.columns, strict=True)]
            if n_chars in batch.schema.names:
                i = batch.schema.get_field_index(n_chars)
                columns[i] = pa.array([None if t is None else len(t) for t in new], batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(rewrite, docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    return detect(on_all_cores(table(spark, sf_dir, "documents").select("doc_id", "text")))
