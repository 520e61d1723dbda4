"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts (type, text, ref, n_tokens). The visitor flattens it in order: a text part is
its escaped text; an image, audio or document part (any other type counts as document) is a placeholder with its number
in the turn, and its reference and expanded token count are recorded. The template wraps each turn as

    <|im_start|>role\\ncontent<|im_end|>\\n

Escaping turns `&`, `<` and `[` into `&amp;`, `&lt;` and `&#91;` (in roles line feeds, too), so no control string of
this or another common template can stand in a text, and undoing it in the reverse order is exact.

A conversation may hold a large share of all rows: turns are first gathered in segments of SEGMENT turn numbers, which
are formatted and read back on their own, and only the segments' strings meet in the conversation.

Defined cases: turns go by number, ties by role and then parts as given (not as escaped), null numbers first; a null text or role is empty; a
null conversation id is a conversation; repeated rows are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import table

START, END, SEGMENT = "<|im_start|>", "<|im_end|>\n", 64
MODALITIES = ("image", "audio", "document")
#: In the order of escaping; the reverse undoes it.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))
PARTS = "array<struct<type:string,text:string,ref:string,n_tokens:int>>"
PLACEHOLDER = r"<\|(image|audio|document):([0-9]+)\|>"


def escape(text: Column, escapes: tuple = ESCAPES) -> Column:
    for plain, safe in escapes:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column, escapes: tuple = ESCAPES) -> Column:
    for plain, safe in reversed(escapes):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as parts."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("n_tokens")))


def modality(kind: Column) -> Column:
    return F.when(kind.isin(*MODALITIES), kind).otherwise(F.lit("document"))


def visit(parts: Column) -> Column:
    """The content of a turn: texts escaped, other parts as numbered placeholders."""
    numbered = F.transform(parts, lambda p, i: F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), modality(F.coalesce(p["type"], F.lit(""))), F.lit(":"), i.cast("string"), F.lit("|>"))))
    return F.array_join(numbered, "")


def attachments(parts: Column) -> Column:
    """type, place among the parts, ref and n_tokens of the parts that aren't text."""
    placed = F.transform(parts, lambda p, i: F.struct(modality(F.coalesce(p["type"], F.lit(""))).alias("type"), i.alias("place"), p["ref"].alias("ref"), F.coalesce(p["n_tokens"], F.lit(0)).alias("n_tokens"), (p["type"] == "text").alias("plain")))
    return F.transform(F.filter(placed, lambda p: ~F.coalesce(p["plain"], F.lit(False))), lambda p: F.struct(p["type"].alias("type"), p["place"].alias("place"), p["ref"].alias("ref"), p["n_tokens"].alias("n_tokens")))


def plain_text(content: Column) -> Column:
    """A content's texts, unescaped. Texts hold no `<` of their own, so whatever begins with one is a placeholder."""
    return unescape(F.regexp_replace(content, PLACEHOLDER, ""))


def parts_of(content: Column) -> Column:
    """A content's parts in order: type, text (of texts) and place (of placeholders)."""
    pieces = F.regexp_extract_all(content, F.lit(f"{PLACEHOLDER}|[^<]+"), F.lit(0))
    said = lambda x, n: F.regexp_extract(x, PLACEHOLDER, n)
    is_text = lambda x: ~x.startswith("<")
    return F.transform(pieces, lambda x: F.struct(
        F.when(is_text(x), "text").otherwise(said(x, 1)).alias("type"), F.when(is_text(x), unescape(x)).alias("text"), F.when(~is_text(x), said(x, 2).cast("int")).alias("place")))


def segments(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted segments of the conversations of turns (conv_id, turn, role, parts).

    mask: starts and lengths of the loss roles' contents in the segment's string, in code points."""
    rows = turns.select("conv_id", F.floor(F.col("turn") / SEGMENT).alias("segment"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(PARTS)).alias("parts")).alias("t"))
    ordered = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list("t")).alias("raw"))
    shaped = F.transform("raw", lambda t: F.struct(
        t["turn"].alias("turn"), t["role"].alias("role"), visit(t["parts"]).alias("content"),
        F.concat(F.lit(START), escape(t["role"], ROLE_ESCAPES), F.lit("\n")).alias("head"), attachments(t["parts"]).alias("attachments")))
    ordered = ordered.select("conv_id", "segment", shaped.alias("ts"))
    sizes = F.transform("ts", lambda t: F.length(t["head"]) + F.length(t["content"]) + len(END))
    place = lambda s: F.transform("ts", lambda t, i: F.struct(
        (F.aggregate(F.slice(s, F.lit(1), i), F.lit(0), lambda a, n: a + n) + F.length(t["head"])).alias("start"),
        F.length(t["content"]).alias("length"), t["role"].isin(*loss_roles).alias("loss")))
    placed = F.get(F.transform(F.array(sizes), place), F.lit(0))  # bound to a name, the sizes are worked out once
    return ordered.select(
        "conv_id", "segment",
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter(placed, lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("mask"),
        F.flatten(F.transform("ts", lambda t: F.transform(t["attachments"], lambda a: F.struct(t["turn"].alias("turn"), a["type"].alias("type"), a["place"].alias("place"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens"))))).alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Segments with what their strings say: the turns (role, text and parts) and the text under the mask, unescaped.

    A part is a text, or a placeholder's type and number; neighbouring texts have become one. text is the texts alone."""
    bodies = F.filter(F.split("formatted", F.lit(END.replace("|", r"\|"))), lambda x: x != "")
    turns = F.transform(bodies, lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1), ROLE_ESCAPES).alias("role"), F.substr(x, F.instr(x, "\n") + 1).alias("content")))
    turns = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), plain_text(t["content"]).alias("text"), parts_of(t["content"]).alias("parts")))
    loss = F.transform("mask", lambda m: plain_text(F.substr(F.col("formatted"), m["start"] + 1, m["length"])))
    return formatted.withColumns({"turns": turns, "loss": F.array_join(loss, "")})


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, mask (in the whole string), attachments and their expanded tokens of each conversation."""
    parts = segments(turns, loss_roles).withColumn("size", F.length("formatted"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "formatted", "mask", "attachments", "size"))).alias("s"))
    before = F.transform("s", lambda x, i: F.aggregate(F.slice("s", F.lit(1), i), F.lit(0), lambda a, y: a + y["size"]))
    moved = F.transform(F.arrays_zip(F.col("s").alias("s"), before.alias("b")), lambda z: F.transform(z["s"]["mask"], lambda m: F.struct((m["start"] + z["b"]).alias("start"), m["length"].alias("length"))))
    whole = whole.select("conv_id", F.array_join(F.transform("s", lambda x: x["formatted"]), "").alias("formatted"), F.flatten(moved).alias("mask"), F.flatten(F.transform("s", lambda x: x["attachments"])).alias("attachments"))
    return whole.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]))


PROBE = "</s>[INST] ok [/INST]"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the probe -7, formatted and read back."""
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = read_back(segments(rows.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = back.select("conv_id", F.struct("segment", F.size("turns").alias("n"), said.alias("said"), "loss", F.length("formatted").alias("chars")).alias("s"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    total = lambda name: F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x[name])
    text = lambda name: F.array_join(F.transform("s", lambda x: x[name]), "")
    return whole.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(text("said"), 256).alias("turns_sha256"), F.length(text("loss")).cast("long").alias("loss_chars"),
        F.sha2(text("loss"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, 24 + length(role) + length(text)
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) - length(text)
    + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) - length(role) AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
