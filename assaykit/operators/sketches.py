"""Summaries that add up (an extension): one row of counts and sketches for each day and key, merged without the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of quantile sketches (a rank is off by about 1/k) and of distinct-count sketches (2 to this power; off by about 1.04 / sqrt of that).
RANKS, DISTINCT = 800, 12


def daily(df: DataFrame, day: Column, keys: list[str], value: str, item: str, hits: dict[str, Column] | None = None) -> DataFrame:
    """(day, keys, n, n_values, values, items, and the count of each of hits): sketches are partial aggregates, a row each a task and key.

    values: a sketch of the non-null values, as whole numbers; items: of the distinct items. Null keys are
    keys like any other.
    """
    counts = [F.count_if(hit).alias(name) for name, hit in (hits or {}).items()]
    x = F.col(value).cast("long")
    return df.groupBy(day.alias("day"), *keys).agg(F.count("*").alias("n"), F.count(x).alias("n_values"), F.kll_sketch_agg_bigint(x, RANKS).alias("values"), F.hll_sketch_agg(F.col(item), DISTINCT).alias("items"), *counts)


def store_days(table: DataFrame, path: str) -> None:
    """Write each day of a daily table as a partition of path; a day that is there is replaced, so days can be written again."""
    table.write.option("partitionOverwriteMode", "dynamic").partitionBy("day").mode("overwrite").parquet(path)


def read_days(spark: SparkSession, path: str, begin: str | None = None, end: str | None = None) -> DataFrame:
    """Stored days from `begin` to before `end`; other days' files aren't read."""
    df = spark.read.parquet(path)
    day = F.col("day").cast("date")
    for condition in ((day >= F.lit(begin).cast("date")) if begin else None, (day < F.lit(end).cast("date")) if end else None):
        df = df if condition is None else df.where(condition)
    return df


def summed(days: DataFrame, keys: list[str], percents: tuple[float, ...] = (50, 95), rollup: bool = True) -> DataFrame:
    """(keys, level, counts, distinct, p50, p95, ...) of stored days; with rollup for each prefix of keys too, whose other keys are null.

    level: how many keys are summed over, which tells a sum from a null key. Percentiles are of values, off by
    about 1/RANKS of the rows in rank; without values they are null.
    """
    counts = [c for c in days.columns if c not in ("day", "values", "items", *keys)]
    grouped = days.rollup(*keys) if rollup else days.groupBy(*keys)
    level = F.length(F.replace(F.conv(F.grouping_id().cast("string"), 10, 2), F.lit("0"), F.lit(""))) if rollup else F.lit(0)
    merged = grouped.agg(level.cast("int").alias("level"), *(F.sum(c).alias(c) for c in counts), F.hll_sketch_estimate(F.hll_union_agg("items")).alias("distinct"), F.kll_merge_agg_bigint(F.when(F.col("n_values") > 0, F.col("values"))).alias("values"))
    quantiles = (F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_bigint("values", F.lit(p / 100.0))).alias(f"p{p:g}") for p in percents)
    return merged.select(*keys, "level", *counts, "distinct", *quantiles)
