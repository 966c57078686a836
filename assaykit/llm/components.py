"""Connected components of a graph in a table, by alternating large and small stars.

Each round is two aggregations and two joins over the edges; nothing is collected. Edges end as
stars whose centre is the smallest node of the component, in about log2 of the diameter rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import forget, kept


def _round(edges: DataFrame) -> DataFrame:
    """edges: (u, v) with u > v. One large-star step, then one small-star step."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, label) for each node of edges (a, b), label being the smallest node it reaches.

    Repeated, reversed, looped and null edges are fine: the last two say nothing. A node that no
    other is linked to isn't returned. No edges give no rows. The table is written; the caller forgets it.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct()
    now, mark = kept(now, "edges"), None
    for _ in range(rounds):
        old, now = now, kept(_round(now), "stars")
        forget(old)
        last, mark = mark, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        if mark == last:
            break
    else:
        raise RuntimeError("the components didn't settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out = kept(stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct()), "members")
    forget(now)
    return out
