"""A collection loop: listings from a paged source, screened, told apart by id and content from all that the pool has, appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.text import dedupe_key, describe_listing, in_length_bounds, listing_scope_text, normalise, out_of_scope_term
from assaykit.operators.queue import greedy_two_keys
from assaykit.shared import checkpointed
from assaykit.sources.pool import append_once, read_pool_at, snapshot
from assaykit.sources.web import collect_pages

#: A collected row: what a pool holds, its key, and the page and place where it was found.
COLLECTED = "source_id string, source string, input string, collected_at string, categories string, labels string, quantity string, transforms array<string>, key string, page int, position int"
#: What the source is asked for.
COLUMNS = ("code", "product_name", "brands", "quantity", "packaging", "categories", "labels")


def screened_listings(records: DataFrame, source: str, collected_at: str) -> DataFrame:
    """Records (page, position, COLUMNS) as COLLECTED rows with `reason` (null: may be kept) and `term`.

    Reasons, the first that holds: no_id, no_name, length, out_of_scope (term says why). Nulls are empty texts.
    """
    df = records.withColumn("_listing", describe_listing(*(F.col(c) for c in ("product_name", "brands", "quantity", "packaging"))))
    df = normalise(df, "_listing", out="input", applied="transforms")
    term = out_of_scope_term(listing_scope_text(F.col("input"), *(F.col(c) for c in ("categories", "labels", "product_name"))))
    reason = F.when(F.coalesce("code", F.lit("")) == "", "no_id").when(F.col("_listing") == "", "no_name").when(~in_length_bounds(F.col("input")), "length")
    df = df.withColumns({"source_id": F.col("code"), "source": F.lit(source), "collected_at": F.lit(collected_at), "key": dedupe_key(F.col("input"), None), "_reason": reason, "_term": term})
    df = df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("categories", "labels", "quantity")})
    names = [c.split()[0] for c in COLLECTED.split(", ")]
    return df.select(*names, F.coalesce("_reason", F.when(F.col("_term").isNotNull(), "out_of_scope")).alias("reason"), F.when(F.col("_reason").isNull(), F.col("_term")).alias("term"))


def new_rows(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows, in the order of (page, position), whose id and key neither the pool nor a row kept before them has; a dropped row holds neither.

    Ids and keys of the pool are compared as two anti-joins of narrow columns; what is left is settled by greedy_two_keys.
    """
    left = rows.join(pool.select("source_id").distinct(), "source_id", "left_anti").join(pool.select("key").distinct(), "key", "left_anti")
    placed = left.withColumn("_place", F.col("page").cast("long") * (1 << 31) + F.col("position"))
    return greedy_two_keys(placed, "source_id", "key", "_place").drop("_place")


def lander(path: str, source: str, collected_at: str, counts: list[dict] | None = None) -> Callable[[DataFrame, int], None]:
    """For collect_pages: screens a micro-batch, and appends what is new to the pool at `path` as one batch, once.

    counts gets a dict of each batch: its number, rows kept, and rows dropped by reason.
    """

    def land(records: DataFrame, batch: int) -> None:
        spark = records.sparkSession
        rows = checkpointed(screened_listings(records, source, collected_at))
        now = snapshot(spark, path)
        fit = rows.where(F.col("reason").isNull()).drop("reason", "term")
        kept = append_once(new_rows(fit, read_pool_at(spark, now, COLLECTED)), path, source, batch)
        if counts is not None:
            dropped = {r.reason: r.n for r in rows.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n")).collect()}  # a row for each reason
            counts.append({"batch": batch, "kept": kept, **dropped, "duplicate": fit.count() - kept})

    return land


def collect_listings(spark: SparkSession, options: dict[str, str], path: str, checkpoint: str, source: str, collected_at: str) -> tuple[dict | None, list[dict]]:
    """Collect listings until the source ends or fails: (why it stopped, counts of each batch). Called again, it goes on where it stopped."""
    counts: list[dict] = []
    told = collect_pages(spark, options | {"columns": ",".join(COLUMNS)}, checkpoint, lander(path, source, collected_at, counts))
    return told, counts
