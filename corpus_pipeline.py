"""The corpus pipeline: documents that pass each stage, encoded at the end.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return documents with
their columns, among them any that documents may have besides their own. An empty table stays empty in each stage. What a
stage does with nulls, empty texts, ties and repeated rows is said at each one; texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import decontaminate, pieces, pii, quality, simhash
from tarn.llm.common import stored, table

#: Words of a document inside windows of benchmark items that don't remove it yet: an item of so few words is no passage.
HIT_WORDS = 4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled ones, doesn't reject.

    A null or empty text is scored like any other; repeated rows are kept or rejected together; rows without a label or
    id don't train."""
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")), keep=True)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (of the smallest id) of each group of near-duplicates: five-word shingles, similarity 0.8.

    All wordless texts (null, empty, white space) are one group; a row without an id stays only if its group has no id;
    of rows with the same id and group the first in the input stays."""
    return simhash.distinct_documents(docs, shingle=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at most HIT_WORDS words inside windows of benchmark items.

    Null and wordless texts stay; repeated rows stay or go together; wordless items never occur."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), most=HIT_WORDS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars counts the new text.

    Null and empty texts stay as they are; of overlapping spans the first one's kind stands for all."""
    return pii.redact(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, the pieces' byte spans and the decoded text of every document.

    A null or empty text has no ids and decodes to the empty text; repeated rows are encoded each on its own."""
    return pieces.encode(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("pieces", pieces_stage),
]

#: A trained classifier, a search by fingerprints and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet in the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
