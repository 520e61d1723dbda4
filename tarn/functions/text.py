"""Text columns: boilerplate removal, query normalisation, tokens and flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as contest boilerplate, in the order of removal. (?m): anchors at lines.
BOILERPLATE = (
    r"(?m)^\s*(?:import\s+sys|from\s+sys\s+import\s+stdin[^\n]*)",
    r"(?m)^\s*input\s*=\s*(?:sys\.)?stdin\.readline[^\n]*",
    r"(?m)^\s*print\s*=\s*(?:sys\.)?stdout\.write[^\n]*",
    r"(?m)^\s*(?:sys\.)?setrecursionlimit\([^\)]*\)",
    r"(?m)^\s*threading\.stack_size\([^\)]*\)",
    r"(?m)^\s*INF\s*=\s*(?:float\(['\"]inf['\"]\)|\d+e\d+|\d{9,})",
    r"(?m)^\s*MOD\s*=\s*(?:10\*\*9\s*\+\s*7|998244353)",
    r"(?im)^\s*#\s*-*.*(?:template|author|created|solution).*",
)
ANY_ORDER = r"(?i)\b(in any order|any order|any valid|any of them|print any)\b"
TERM = r"[A-Za-z_][A-Za-z0-9_]*|\d+|\S"
NUMBER = r"(?<![\w.])-?\d+(?:\.\d+)?(?![\w.])"
COMMON_NUMBERS = ("0", "1", "2", "10", "100")
QUERY_CHARS, EXAMPLE_HEAD = 32_000, 100


def strip_space(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_boilerplate(code: Column) -> Column:
    """Code without boilerplate lines, at most one blank line in a row; null is empty."""
    text = F.coalesce(code, F.lit(""))
    for pattern in BOILERPLATE:
        text = F.regexp_replace(text, pattern, "")
    return strip_space(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def drop_examples(text: Column) -> Column:
    """The part before the first example heading, if it is longer than EXAMPLE_HEAD characters; else the text."""
    head = F.get(F.split(text, r"(?i)\n(?:examples?|sample input)", 2), F.lit(0))
    return F.when(F.length(head) > EXAMPLE_HEAD, head).otherwise(text)


def normalise_query(text: Column, max_chars: int = QUERY_CHARS, without_examples: bool = False) -> Column:
    """Trimmed, runs of blanks and of blank lines collapsed, cut at max_chars; null is empty."""
    text = strip_space(F.coalesce(text, F.lit("")))
    if without_examples:
        text = drop_examples(text)
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.substring(text, 1, max_chars)


def or_blank(text: Column) -> Column:
    """A blank text as a single space, so that an encoder has something to encode."""
    return F.when(strip_space(F.coalesce(text, F.lit(""))) == "", F.lit(" ")).otherwise(text)


def allows_any_order(statement: Column) -> Column:
    return F.coalesce(statement, F.lit("")).rlike(ANY_ORDER)


def statement_numbers(statement: Column, at_least: int = 3) -> Column:
    """Distinct numbers of a statement in the order of strings, without common ones; none if there are too few."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(statement, F.lit("")), F.lit(NUMBER), F.lit(0)))
    rare = F.filter(found, lambda n: ~F.regexp_replace(n, "^-+", "").isin(*COMMON_NUMBERS))
    return F.when(F.size(rare) >= at_least, F.array_sort(rare)).otherwise(F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    """Lower-cased words, numbers and single other characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: an expression named inside a lambda would be for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_bigrams(words: Column) -> Column:
    """Words followed by their pairs of neighbours."""

    def joined(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))

    return bound(words, joined)


def normalised_text(code: Column) -> Column:
    """Code that can't be parsed, for its id: no comments, single spaces, no blank lines."""
    text = F.regexp_replace(F.coalesce(code, F.lit("")), r"\r\n?", "\n")
    lines = F.transform(F.split(text, "\n"), lambda x: strip_space(F.regexp_replace(F.substring_index(x, "#", 1), r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def text_id(code: Column) -> Column:
    """The content id of code that can't be parsed."""
    return F.sha2(F.concat(F.lit("text"), F.lit("\0"), normalised_text(code)), 256)
