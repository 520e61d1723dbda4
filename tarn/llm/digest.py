"""Exact document fingerprints over canonical texts, in DataFrame functions only.

A text is brought to Unicode NFKC, case-folded, brought to NFKC again, and its runs of white space become one space,
none at the ends. The fingerprint is 128 bits of XXH64 with two seeds. Documents with equal fingerprints are one bucket;
inside a bucket the canonical texts' bytes are compared by grouping on them, and where a bucket holds different texts
their fingerprints are told apart by a SHA-256 behind the bucket's value. So fingerprints are equal exactly if the
canonical texts are.

The next document in the order of ids is found without sorting everything in one task: bounds at quantiles of the ids
deal the rows out into cells, cells of many characters are divided evenly by id, and those of a null id or of an id with
very many rows by hash. There are at most QUANTILES times SUBS buckets and QUANTILES for null ids, whatever the input, so
their first rows' places in the order (no texts) can be broadcast: each bucket also borrows the first row of the bucket
after it, and a window inside each bucket does the rest.

Defined cases: a null text is empty; rows go by id (null first), ties by hash of the text and then the text; a single
row is followed by itself; repeated rows get rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import table

#: Characters a cell of neighbours aims at, and those beyond which it is divided; the bounds on the number of quantiles.
BUCKET_CHARS, BUCKET_CHARS_MOST, QUANTILES, SUBS, LEAST = 4_000_000, 64_000_000, 4096, 64, 64


def canonical(text: Column) -> Column:
    """The canonical form; Unicode work is ICU's, called in the JVM."""
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = compose(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x85]+", " "))


def wide_hash(canon: Column) -> list[Column]:
    """Two columns of 64 bits each, w1 and w2."""
    return [F.xxhash64(canon).alias("w1"), F.xxhash64(F.lit("wide"), canon).alias("w2")]


def hex_of(w1: str, w2: str) -> Column:
    part = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.concat(part(w1), part(w2))


def raw_sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def buckets(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each wide hash (b1, b2) an array `of` its different texts: SHA-256, rows and smallest id.

    Grouping is by hash and bytes; equal texts are summed up before the shuffle, so a text with very many copies is
    a row a task."""
    canon = docs.select("doc_id", canonical(F.col(text)).alias("canon")).select("doc_id", "canon", *wide_hash(F.col("canon")))
    texts = canon.groupBy("w1", "w2", "canon").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).select("w1", "w2", raw_sha(F.col("canon")).alias("sha"), "copies", "first_id")
    return texts.groupBy(F.col("w1").alias("b1"), F.col("w2").alias("b2")).agg(F.collect_list(F.struct("sha", "copies", "first_id")).alias("of"))


def with_bucket(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (w1, w2, sha) with texts, the number of different texts of their hash, and copies and first_id of their own.

    Buckets join on half of the hash, which isn't how they were grouped: so they are dealt out anew and adaptive
    execution can split the rows of a bucket with very many."""
    joined = rows.join(buckets(docs), F.col("w1") == F.col("b1"))
    own = F.get(F.filter("of", lambda x: x["sha"] == F.col("sha")), F.lit(0))
    # as an equality the other half would become a key, too
    return joined.where(F.col("w2").bitwiseXOR(F.col("b2")) == 0).withColumns({"texts": F.size("of"), "copies": own["copies"], "first_id": own["first_id"]}).drop("of", "b1", "b2")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint, copies (rows with the same canonical text) and first_id, their smallest id."""
    canon = docs.select("doc_id", canonical(F.col("text")).alias("canon"))
    rows = canon.select("doc_id", *wide_hash(F.col("canon")), raw_sha(F.col("canon")).alias("sha"))
    return with_bucket(rows, docs).select("doc_id", told_apart().alias("fingerprint"), "copies", "first_id")


def told_apart() -> Column:
    wide = hex_of("w1", "w2")
    return F.when(F.col("texts") > 1, F.concat(wide, F.lit("-"), F.lower(F.hex("sha")))).otherwise(wide)


def _buckets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with _hash, and _c and _s, whose order is that of key (null first) and _hash."""
    plan = docs.agg(F.sum(F.length(text)).alias("chars"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    chars = plan["chars"] or 0
    cells = min(QUANTILES, max(LEAST, chars // BUCKET_CHARS))
    subs = min(SUBS, max(1, chars // (cells * BUCKET_CHARS_MOST)))
    found = docs.agg(F.percentile_approx(key, [i / cells for i in range(1, cells)], 10 * cells)).first()[0] or []
    bounds = sorted({*found, plan["low"], plan["high"]} - {None})
    hot = {b: n * subs for b, n in Counter(found).items() if n > 1}  # ids with more rows than a cell should have
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    rows = docs.withColumn("_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    place = F.size(F.filter(cuts, lambda b: b < F.col(key)))
    # an id with very many rows is the last of its cell and gets one of its own
    parts = F.when(F.col(key).isNull(), F.lit(cells))
    if hot:
        parts = parts.otherwise(F.element_at(F.map_from_arrays(F.array(*map(F.lit, hot)), F.array(*map(F.lit, hot.values()))), F.col(key)))
    rows = rows.withColumns({"_place": place, "_parts": parts})
    low, high = F.get(cuts, F.col("_place") - 1), F.get(cuts, F.col("_place"))
    by_id = F.least(F.floor((F.col(key) - low) / (high - low) * subs), F.lit(subs - 1))
    by_hash = F.floor((F.col("_hash") / F.lit(2.0**64) + 0.5) * F.col("_parts"))
    cell = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(2 * F.col("_place") + F.col("_parts").isNotNull().cast("int"))
    sub = F.when(F.col("_parts").isNotNull(), by_hash).when(low.isNull(), F.lit(0)).otherwise(by_id)
    return rows.withColumns({"_c": cell, "_s": sub.cast("int")}).drop("_place", "_parts")


def with_next(docs: DataFrame, carried: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (key, text and carried) with columns next_*, those of the row after it; the last is followed by the first."""
    columns = [key, text, *carried]
    rows = _buckets(docs, key, text)
    order = F.struct(F.col(key).isNotNull().alias("there"), F.col(key).alias("k"), F.col("_hash").alias("h"))
    names = rows.groupBy("_c", "_s").agg(F.min(order).alias("_first"))
    # the bucket before each one: in the same cell, or the last of the cell before
    cells = names.groupBy("_c").agg(F.max("_s").alias("_s"))
    line, last = Window.orderBy("_c"), F.struct("_c", "_s")
    cells = cells.select("_c", F.coalesce(F.lag(last).over(line), F.last(last).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_far"))
    near = F.lag("_s").over(Window.partitionBy("_c").orderBy("_s"))
    names = names.withColumn("_near", near).join(cells, "_c")
    names = names.select("_c", "_s", "_first", F.when(F.col("_near").isNull(), F.col("_far")).otherwise(F.struct("_c", F.col("_near").alias("_s"))).alias("_before"))
    marked = rows.join(F.broadcast(names), ["_c", "_s"])
    here = F.struct(F.col("_c"), F.col("_s"), F.lit(False).alias("borrowed"))
    lent = F.struct(F.col("_before._c").alias("_c"), F.col("_before._s").alias("_s"), F.lit(True).alias("borrowed"))
    dealt = marked.select(*columns, "_hash", F.explode(F.when(order == F.col("_first"), F.array(here, lent)).otherwise(F.array(here))).alias("_at"))
    within = Window.partitionBy("_at._c", "_at._s").orderBy("_at.borrowed", F.col(key).asc_nulls_first(), "_hash", text)
    following = [F.lead(c).over(within).alias(f"next_{c}") for c in columns]
    return dealt.select("*", *following).where(~F.col("_at.borrowed")).drop("_at", "_hash")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document, its edited text and the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    canon = docs.withColumn("canon", canonical(F.col("text")))
    # a canonical text is worked out again rather than sent along
    paired = with_next(canon.select("doc_id", "text", *wide_hash(F.col("canon"))), ["w1", "w2"]).withColumn("sha", raw_sha(canonical(F.col("text"))))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    paired = paired.select("doc_id", "text", "w1", "w2", "sha", "next_text", "next_w1", "next_w2", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    paired = paired.withColumn("edited_canon", canonical(F.col("edited")))
    e1, e2 = wide_hash(F.col("edited_canon"))
    paired = paired.withColumns({"e1": e1, "e2": e2, "e_sha": raw_sha(F.col("edited_canon")), "edited_sha256": raw_sha(F.col("edited"))})
    # where hashes are equal, the canonical texts' bytes are compared
    same = lambda a, b, other: F.when((F.col("w1") == F.col(a)) & (F.col("w2") == F.col(b)), canonical(F.col("text")) == other).otherwise(False)
    paired = paired.select(
        "doc_id", "w1", "w2", "sha", "n_chars", "edited_sha256", "e1", "e2", "e_sha",
        same("e1", "e2", F.col("edited_canon")).alias("near_edited"), same("next_w1", "next_w2", canonical(F.col("next_text"))).alias("near_next"))
    # on half of the hash again, so that rows of an edited text with very many copies can be split
    met = with_bucket(paired, docs).join(buckets(docs), (F.col("e1") == F.col("b1")) & (F.col("e2").bitwiseXOR(F.col("b2")) == 0), "left")
    met = met.withColumn("shas", F.transform("of", lambda x: x["sha"]))
    likeness = lambda c: F.when(F.col(c), 1.0).otherwise(0.0).alias(c)
    wide, others = hex_of("e1", "e2"), F.size(F.filter("shas", lambda x: x != F.col("e_sha")))
    edited_print = F.when(F.col("shas").isNotNull() & (others > 0), F.concat(wide, F.lit("-"), F.lower(F.hex("e_sha")))).otherwise(wide)
    return met.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), told_apart().alias("fingerprint"), edited_print.alias("edited_fingerprint"),
        likeness("near_edited"), likeness("near_next"), "copies", "first_id",
    )
