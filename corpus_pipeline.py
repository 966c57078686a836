"""The corpus pipeline: quality, toxicity, near duplicates, packing. Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaykit.llm.common import forget, kept, table
from assaykit.llm.packing import packed_rows
from assaykit.llm.quality import keep_quality
from assaykit.llm.simhash import representatives
from assaykit.llm.toxicity import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored like others; repeated rows stay or go together; labels that are
    null, neither 0 nor 1, or contradict each other teach nothing. All columns of docs are returned,
    whatever their names. No rows give no rows.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts. Nulls, repeats, labels and columns: as in quality."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, with all columns of docs.

    The first has the smallest id, of ties the smallest text hash; of equal rows one stays. Texts
    without words, null ones too, are one group; a null id is first only in a group without others.
    Very long texts are compared whole. No rows give no rows.
    """
    return representatives(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, of any length; a null text is an empty one, with the end alone. No rows give no rows."""
    return packed_rows(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]
#: SQL can't express the learned stages or the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's table is written, and goes when the next one is; the last one written stays for the rows returned."""
    docs = table(spark, sf_dir, "documents")
    written = None
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
        if written is not None:
            forget(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
