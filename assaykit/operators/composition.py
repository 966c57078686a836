"""What a labelled set is made of: strata against targets, histograms, funnel, word statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit import labels as L
from assaykit.functions.regex import word_count
from assaykit.operators.validation import reason_code


def strata(df: DataFrame, column: str = "difficulty", targets: dict[str, float] = L.TARGETS, tolerance: float = L.DRIFT) -> DataFrame:
    """(stratum, target, n, share, drifted, band) for every target, absent ones with 0."""
    n = df.groupBy(F.col(column).alias("stratum")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    want = df.sparkSession.createDataFrame(list(targets.items()), "stratum string, target double")
    out = F.broadcast(want).join(n, "stratum", "left").join(F.broadcast(total))
    share = F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), F.col("total")), F.lit(0.0))
    out = out.select("stratum", "target", F.coalesce("n", F.lit(0)).alias("n"), share.alias("share"))
    gap = F.abs(F.col("share") - F.col("target"))
    band = F.when(F.col("share") == 0, "critical").when(gap <= F.greatest(0.25 * F.col("target"), F.lit(0.02)), "good").when(F.col("share") > F.col("target"), "warn").otherwise("other")
    return out.withColumns({"drifted": gap > tolerance, "band": band})


def histogram(df: DataFrame, value: Column, pos: str) -> DataFrame:
    """(value, n, first): order by n descending, then first, for the most common first."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(pos).alias("first"))


def reason_histogram(df: DataFrame, notes: str = "labeller_notes") -> DataFrame:
    return df.groupBy(F.coalesce(reason_code(F.col(notes)), F.lit("?")).alias("reason")).agg(F.count("*").alias("n"))


def tag_count(df: DataFrame, tag: str, tags: str = "tags") -> DataFrame:
    return df.agg(F.count_if(F.array_contains(tags, tag)).alias("n"))


def word_statistics(df: DataFrame, column: str) -> DataFrame:
    """(n, median, max, n_long): the upper median of word counts, from counts of distinct counts."""
    counts = df.groupBy(word_count(F.col(column)).alias("w")).agg(F.count("*").alias("c"))  # one row for each count of words
    whole = Window.partitionBy()
    long = F.when(F.col("w") >= L.LONG_WORDS, F.col("c"))
    run = counts.withColumns(
        {
            "cum": F.sum("c").over(whole.orderBy("w").rowsBetween(Window.unboundedPreceding, 0)),
            "n": F.sum("c").over(whole),
            "max": F.max("w").over(whole),
            "n_long": F.coalesce(F.sum(long).over(whole), F.lit(0)),
        }
    )
    at = run.where(F.col("cum") >= F.floor(F.col("n") / 2) + 1)
    return at.groupBy("n", "max", "n_long").agg(F.min("w").alias("median")).select("n", "median", "max", "n_long")


def funnel(pool: DataFrame, first_pass: DataFrame, golden: DataFrame) -> DataFrame:
    """One row of stage counts, from the three tables."""
    a = pool.agg(F.count_if(F.col("source") == "off").alias("listings"), F.count_if(F.col("source") == "aar").alias("rulings"))
    b = first_pass.agg(
        F.count("*").alias("suggestions"),
        F.count_if(F.coalesce(F.col("heading"), F.lit("")) != "").alias("with_heading"),
        F.count_if(F.coalesce(F.size("label_alternatives"), F.lit(0)) > 0).alias("ambiguous"),
        F.count_if((F.col("label") != L.UNCERTAIN) & (F.coalesce(F.col("heading"), F.lit("")) != "")).alias("grounded"),
    )
    c = golden.agg(F.count("*").alias("golden"), F.count_if(F.col("labelled_by").isin("human", "human-reviewed")).alias("human"), F.count_if(F.col("labelled_by").isin(*L.DERIVED)).alias("derived"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))
