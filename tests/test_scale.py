"""Plans and operators that must not put a group in one task, or search a text twice."""

import random

import pytest
from pyspark.sql import functions as F

from assaykit.operators import agreement, evaluation, queue
from assaykit.operators.ordering import placed
from assaykit.plans.registry import QUERIES, _scored

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_scoring_pass(spark):
    for name in ("run_summary", "leaderboard_rank"):
        assert plan(QUERIES[name](spark, DIR)).count("regexp_extract(") < 12, name
    assert plan(_scored(spark, DIR)).count("Join") == 0
    assert plan(QUERIES["leaderboard_rank"](spark, DIR)).count("Relation") <= 2


def test_places_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(k, "hot" if k % 3 else rng.choice(["a", "b", None]), rng.randrange(5), rng.randrange(9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "pos long, g string, _part int, x int").repartition(7)
    got = placed(df, {"key": F.col("g")}, ["pos"], "turn", {"total": F.col("x")}).collect()
    seen, total, size = {}, {}, {}
    for _, g, _, _ in rows:
        size[g] = size.get(g, 0) + 1
    want = {}
    for pos, g, p, x in sorted(rows):
        seen[g], total[g] = seen.get(g, 0) + 1, total.get(g, 0) + x
        want[pos] = (g, p, x, seen[g], size[g], total[g])
    assert {r.pos: (r.g, r._part, r.x, r.turn, r.turn_of, r.total) for r in got} == want
    assert placed(df.limit(0), {"key": F.col("g")}, ["pos"], "turn").count() == 0
    assert sorted(r.turn for r in placed(df, {}, ["pos"], "turn").collect()) == list(range(1, 3001))


def test_running_accuracy_of_one_key(spark):
    rows = [("m", k, k % 3 == 0) for k in range(1, 1001)]
    got = evaluation.running_accuracy(spark.createDataFrame(rows, "model string, at int, ok boolean").repartition(5), "model", "at", "ok").collect()
    assert sorted((r.i, r.accuracy) for r in got) == [(i, (i // 3) / i) for i in range(25, 1001, 25)]


def test_batches(spark):
    got = queue.batch_place(spark.range(125).repartition(6), "id", 50).collect()
    assert all((r.batch, r.place) == (r.id // 50, r.id % 50 + 1) for r in got)


def test_interleave_with_clashing_names(spark):
    df = spark.createDataFrame([(k, "g" if k % 4 else "h", k) for k in range(200)], "pos int, g string, _group int")
    got = queue.interleave(df, F.col("g")).orderBy("turn", "group_first").collect()
    assert [r.pos for r in got[:4]] == [0, 1, 4, 2] and all(r._group == r.pos for r in got)


def test_first_wins_with_a_viral_text(spark):
    rows = [(k, "" if k % 3 else f"t{k % 50}", "x") for k in range(600)]
    df = spark.createDataFrame(rows, "pos int, t string, _first string").repartition(5)
    first = {}
    for k, t, _ in rows:
        first.setdefault(t, k)
    got = queue.first_wins(df, F.col("t"))
    assert sorted(r.pos for r in got.collect()) == sorted(first.values()) and got.columns == df.columns
    held = queue.first_wins(df, F.col("t"), protected=F.col("pos") > 595)
    assert sorted(r.pos for r in held.collect()) == sorted({*first.values(), 596, 597, 598, 599}) and held.columns == df.columns


def greedy(rows):
    kept, a, b = [], set(), set()
    for pos, x, y in sorted(rows):
        if x not in a and y not in b:
            kept.append(pos)
            a.add(x)
            b.add(y)
    return kept


@pytest.mark.parametrize("kind", ["chain", "copies", "random"])
def test_greedy_two_keys(spark, kind):
    rng = random.Random(2)
    rows = {
        "chain": [(k, (k + 1) // 2, k // 2) for k in range(24)],  # each row shares a key with the one before it
        "copies": [(k, 1, k % 2) for k in range(300)],
        "random": [(k, rng.randrange(30), rng.randrange(30)) for k in range(200)],
    }[kind]
    df = spark.createDataFrame(rows, "pos int, x int, y int").repartition(3)
    assert sorted(r.pos for r in queue.greedy_two_keys(df, "x", "y").collect()) == greedy(rows)


def test_an_open_domain_has_no_matrix(spark):
    df = spark.range(40).selectExpr("id AS a", "id % 7 AS b")
    with pytest.raises(ValueError, match="closed domains"):
        agreement.confusion(df, most=30)
    assert agreement.confusion(df, most=40).count() == 1600


def test_windows_and_copies_of_a_stream(spark, tmp_path):
    """Event windows close by the watermark; an id that comes twice counts once."""
    from assaykit.streaming import runs

    day = 86_400
    first = [(k, k * 3600, 1, "view", 1.0, "{}") for k in range(48)] + [(3, 3 * 3600, 1, "view", 1.0, "{}")]
    late = [(100, 9 * day, 1, "view", 5.0, "{}"), (101, 9 * day + 1, 1, "view", 5.0, "{}")]
    for name, rows in (("events1", first), ("events2", late)):
        df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
        df.selectExpr("event_id", "timestamp_seconds(864000 + s) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    def drained(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    stream = runs.read_events(spark, f"{tmp_path}/events*.parquet", glob="*.parquet")
    assert len({r.event_id for r in drained(runs.deduplicated(stream), "once", "append")}) == len(spark.table("once").collect()) == 50
    got = drained(runs.windowed(runs.deduplicated(stream), delay=None), "by_day", "append")
    assert sorted((r.n, r.total) for r in got) == [(24, 24.0), (24, 24.0)]


def test_interleaving_sorts_and_keeps_places_alone(spark, monkeypatch):
    from assaykit.operators import ordering, queue

    kept = []
    plain = ordering.checkpointed
    monkeypatch.setattr(ordering, "checkpointed", lambda df: kept.append(set(df.columns)) or plain(df))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = queue.interleave(docs, F.col("lang"), "doc_id")
    assert kept and all("text" not in columns for columns in kept) and set(out.columns) == {*docs.columns, "turn", "group_first"}
    narrow = out.select("doc_id", "turn")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in narrow and out.count() == docs.count()
