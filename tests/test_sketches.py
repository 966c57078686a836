"""Merged sketches against exact counts and ranks; days stored again."""

import bisect

from pyspark.sql import functions as F

from assaykit.operators import sketches


def test_merged_days_against_exact(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").withColumn("stratum", F.when(F.col("user_id") % 7 == 0, None).otherwise(F.col("user_id") % 3)).withColumn("cents", F.floor(F.col("value") * 100))
    table = sketches.daily(events, F.to_date("ts"), ["event_type", "stratum"], "cents", "user_id", {"high": F.col("value") > 50})
    path = f"{tmp_path}/days"
    sketches.store_days(table, path)
    first = table.agg(F.min("day")).first()[0]
    sketches.store_days(table.where(F.col("day") == F.lit(first)), path)  # a day written again is there once
    got = sketches.summed(sketches.read_days(spark, path), ["event_type", "stratum"]).collect()
    rows = events.select("event_type", "stratum", "cents", "user_id", "value").toPandas()
    assert len(got) == 1 + 5 + 5 * 4
    for r in got:
        own = rows if r.level == 2 else rows[rows.event_type == r.event_type]
        if r.level == 0:
            own = own[own.stratum.isna()] if r.stratum is None else own[own.stratum == r.stratum]
        values = sorted(own.cents)
        assert r.n == r.n_values == len(own) and r.high == (own.value > 50).sum()
        assert abs(r.distinct - own.user_id.nunique()) <= 0.06 * own.user_id.nunique() + 1
        for q, p in ((r.p50, 0.5), (r.p95, 0.95)):
            low, high = bisect.bisect_left(values, q) / len(values), bisect.bisect_right(values, q) / len(values)
            assert low - 0.01 <= p <= high + 0.01
    some = sketches.read_days(spark, path, end=str(first))
    assert some.count() == 0 and sketches.summed(some, ["event_type"], rollup=False).count() == 0
    one = sketches.read_days(spark, path, begin=str(first))
    plan = sketches.read_days(spark, path, end=str(first))._jdf.queryExecution().executedPlan().toString()
    assert one.count() == table.count() and "PartitionFilters: [isnotnull(day" in plan


def test_keys_without_values(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-01", "a", None, 1), ("2026-01-02", "a", None, 2), ("2026-01-02", "b", 7, 2), (None, "b", 9, 3)], "d string, k string, v long, u long")
    path = f"{tmp_path}/days"
    sketches.store_days(sketches.daily(df, F.to_date("d"), ["k"], "v", "u"), path)
    got = {(r.k, r.level): r for r in sketches.summed(sketches.read_days(spark, path), ["k"]).collect()}
    assert got["a", 0].p50 is None and got["a", 0].n == 2 and got["b", 0].p50 in (7, 9) and got[None, 1].n == 4 and got[None, 1].distinct == 3
