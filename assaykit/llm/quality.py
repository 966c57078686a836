"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The metadata is the column n_chars of the table, in bins, beside the text's own statistics. Labels,
lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from assaykit.llm.common import remainder, table
from assaykit.llm.fm import ROOT, SAMPLE, SUPPORT, learn, score, score_rows

THRESHOLD, METADATA = 0.3, ("n_chars",)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, support: int = SUPPORT, root: float = ROOT) -> DataFrame:
    """(doc_id, score, predicted) for every row, from labels.quality outside fold 0 of 5.

    Null and empty texts are scored like any other; without usable labels all rows score 0.5, with
    one label alone its smoothed share. Repeated rows are scored each. A table without n_chars, or
    with nulls in it, is scored without. Other columns are left out. No rows give no rows.
    """
    return score(docs, learn(docs, labels, "quality", True, sample, METADATA, support, root), THRESHOLD)


def keep_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, support: int = SUPPORT, root: float = ROOT) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold.

    Scores are those of quality_scores, also for null and empty texts. Of repeated rows all stay or
    none does; columns with names like a score's are kept as they are. No rows give no rows.
    """
    got, score_name = score_rows(docs, learn(docs, labels, "quality", True, sample, METADATA, support, root))
    return got.where(got[score_name] >= THRESHOLD).select(*docs.columns)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Every row of documents; nulls, empty texts and repeats: see quality_scores."""
    got = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
