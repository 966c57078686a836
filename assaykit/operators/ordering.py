"""Places of rows in an order, without a task that holds a whole group.

Rows are cut into ranges of (keys, order), sorted and checkpointed; a row's place in its range comes
from its partition. What a key has in earlier ranges is a running sum over one row for each key and
range. So a key with a third of all rows is spread over as many tasks as it fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.shared import checkpointed, fresh

_PLACES = (1 << 33) - 1


def placed(df: DataFrame, keys: dict[str, Column], order: list[str], turn: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """df's columns, keys, `turn` (a row's place within its keys, from 1), `turn`_of (rows of its keys), and running sums.

    keys: names and values of what makes a group; null is a group like any other. order: columns by
    which a group's rows stand, nulls first; rows that tie stand in any order, the same for all added
    columns. sums: names and values to add up along each group, the row's own included.
    """
    sums = sums or {}
    rows = df.withColumns(keys | sums) if keys or sums else df
    part, at = fresh(rows, "_part"), fresh(rows, "_at")
    by = [*keys, *order]
    if by:
        rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = checkpointed(rows.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACES))}))
    first, many, before = (fresh(rows, x) for x in ("_first", "_many", "_before"))
    added = {s: fresh(rows, f"_sum_{s}") for s in sums}
    each = rows.groupBy(part, *keys).agg(F.min(at).alias(first), F.count("*").alias(many), *(F.sum(s).alias(added[s]) for s in sums))
    key = Window.partitionBy(*keys)
    earlier = key.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    each = each.withColumns(
        {before: F.coalesce(F.sum(many).over(earlier), none), f"{turn}_of": F.sum(many).over(key)} | {added[s]: F.coalesce(F.sum(added[s]).over(earlier), none) for s in sums}
    ).drop(many)
    each = each.select(*(F.col(c).alias(f"_of_{c}") for c in (part, *keys)), first, before, f"{turn}_of", *added.values())
    same = F.col(part) == F.col(f"_of_{part}")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    out = rows.join(each, same).drop(*(f"_of_{c}" for c in (part, *keys)))
    if sums:
        here = Window.partitionBy(part, *keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({s: F.sum(s).over(here) + F.col(added[s]) for s in sums})
    return out.withColumn(turn, F.col(at) - F.col(first) + F.col(before) + 1).drop(part, at, first, before, *added.values())
