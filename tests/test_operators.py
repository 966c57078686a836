import json
import random

import pytest
from pyspark.sql import functions as F

from assaykit.operators import agreement, composition, lookup, queue, validation
from assaykit.sources import jsonl, models, sinks, web
from assaykit.streaming import runs


def test_kappa_example(spark):
    pairs = [("yes", "yes")] * 20 + [("yes", "no")] * 5 + [("no", "yes")] * 5 + [("no", "no")] * 20
    k = agreement.cohen_kappa(spark.createDataFrame(pairs, "a string, b string")).first()
    assert (round(k.observed, 2), round(k.expected, 2), round(k.kappa, 2), k.usable) == (0.8, 0.5, 0.6, True)
    assert k.reading == "substantial"
    same = agreement.cohen_kappa(spark.createDataFrame([("x", "x")] * 3, "a string, b string")).first()
    assert same.kappa == 1.0
    assert agreement.cohen_kappa(spark.createDataFrame([], "a string, b string")).count() == 0
    note = sinks.agreement_markdown(agreement.cohen_kappa(spark.createDataFrame(pairs, "a string, b string")), agreement.confusion(spark.createDataFrame(pairs, "a string, b string")), "T")
    assert "| no | 20 | 5 |" in note


def test_last_human_label_counts(spark):
    v = spark.createDataFrame([(1, "PASS"), (2, "fail"), (3, "PASS")], "example_id int, verdict string")
    h = spark.createDataFrame([(1, "fail", 1), (1, "pass", 2), (2, "pass", 3)], "example_id int, verdict string, pos int")
    got = agreement.judged_pairs(v, h)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "PASS", "PASS"), (2, "PASS", "FAIL")]
    d = agreement.directions(got).first()
    assert (d.lenient, d.strict) == (0, 1)


def test_vote_ties_go_to_the_first_answer(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "y"), ("b", 1, "q"), ("b", 2, "p"), ("c", 1, None), ("c", 2, None)]
    df = spark.createDataFrame(rows, "item string, run int, answer string")
    assert sorted(tuple(r) for r in agreement.majority_vote(df).collect()) == [("a", "y", 2), ("b", "q", 1), ("c", "None", 2)]
    s = agreement.stability(df).first()
    assert (s.items, s.stable) == (3, 1)


def test_relabelled(spark):
    gold = spark.createDataFrame([("a", "5", True, None, None), ("b", "5", True, "1905", "c")], "id string, label string, answerable boolean, heading string, deprecated_by string")
    redo = spark.createDataFrame([("a", "5", True, None), ("b", "3", True, "1905")], "id string, label string, answerable boolean, heading string")
    got = agreement.relabelled(gold, redo).collect()
    assert [(r.id, r.heading, r.gold_heading) for r in got] == [("a", "-", "-")]


@pytest.mark.parametrize("seed", range(3))
def test_two_keys_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, *range(12)]), rng.choice([None, *range(12)])) for i in range(60)]
    a, b, want = set(), set(), []
    for i, x, y in rows:
        if x not in a and y not in b:
            a.add(x)
            b.add(y)
            want.append(i)
    got = queue.greedy_two_keys(spark.createDataFrame(rows, "pos int, x int, y int"), "x", "y")
    assert sorted(r.pos for r in got.collect()) == want


def test_interleave_is_a_permutation_in_turns(spark):
    rows = [(i, g) for i, g in enumerate("aabacbb")]
    got = queue.interleave(spark.createDataFrame(rows, "pos int, g string"), F.col("g")).orderBy("turn", "group_first").collect()
    assert "".join(r.g for r in got) == "abcabab" and sorted(r.pos for r in got) == list(range(7))


def test_queue(spark):
    pool = spark.createDataFrame(
        [("1", "aar", "Coffee beans", "Goa", ["12"], "", 1), ("2", "aar", "cheese", "Goa", None, "", 2), ("3", "off", "coffee", "", ["12"], "", 3), ("4", "aar", "tea", "Kerala", [], "", 4), ("5", "aar", "more coffee", "Kerala", ["5"], "", 5)],
        "source_id string, source string, text string, state string, stale_rates array<string>, categories string, pos int",
    )
    done = spark.createDataFrame([("2",), ("",)], "source_id string")
    ids = lambda **k: [r.source_id for r in queue.select_queue(pool, done, **k).collect()]
    assert ids() == ["1", "3", "4", "5"]
    assert ids(stale="12") == ["1", "3"] and ids(source="aar") == ["1", "4", "5"]
    assert ids(state="goa") == ["1"] and ids(exclude_state="goa") == ["3", "4", "5"]
    assert ids(keyword="COFFEE") == ["1", "3", "5"] and ids(changed_candidates=True, limit=2) == ["1", "3"]
    assert ids(spread_states=True) == ["1", "3", "4", "5"]


def test_first_wins(spark):
    df = spark.createDataFrame([(1, "A-b"), (2, "ab!"), (3, "AB"), (4, "c")], "pos int, t string")
    assert [r.pos for r in queue.first_wins(df, queue.content_key(F.col("t"))).orderBy("pos").collect()] == [1, 4]
    assert [r.pos for r in queue.first_wins(df, queue.content_key(F.col("t")), protected=F.col("pos") == 3).orderBy("pos").collect()] == [1, 3, 4]
    with pytest.raises(ValueError):
        queue.seeded_sample(df, "pos", 9, 1)
    assert len(queue.seeded_sample(df, "pos", 2, 1).collect()) == 2


def test_validation(spark):
    schema = "id string, input string, label string, heading string, answerable boolean, labeller_notes string, difficulty string, source string, justification string, labelled_by string, deprecated_by string"
    good = ("gst-0001", "soap", "18", "3401", True, "", "typical", "off", "because", "human", None)
    rows = [good, ("gst-0002", "soap", "UNCERTAIN", None, True, "", "odd", "", "", "model-first-pass", "gst-0009"), ("x", " ", "28", "34", False, "reason=what", "typical", "zzz", " ", "me", "gst-0001")]
    df = spark.createDataFrame(rows, schema)
    got = [r.p for r in df.select(validation.problems().alias("p")).collect()]
    assert got[0] == []
    assert got[1] == ["labeller_unreviewed", "label_uncertain", "heading_missing", "difficulty_unknown", "justification_empty"]
    assert got[2] == ["labeller_unknown", "id_form", "input_empty", "label_retired", "unanswerable_but_label", "reason_unknown", "unanswerable_difficulty", "heading_form", "source_unknown", "justification_empty"]
    assert [r.p for r in df.select(validation.problems(True).alias("p")).collect()][1] == []
    assert [r.id for r in validation.dangling(df).collect()] == ["gst-0002"]
    assert validation.next_id(df).first().next_id == "gst-0003" and validation.next_id(df.limit(0)).first().next_id == "gst-0001"


def test_lookup(spark):
    text = "intro 3307. Schedule I - 2.5% 1. 3307 Combs. 2. 8471 Things and then 3307 again. Schedule VII - 14% 1. 2402 Old."
    df = spark.createDataFrame([(text,)], "text string")
    got = {(r.heading, r.schedule): r.entry for r in lookup.rated_entries(df).collect()}
    assert set(got) == {("3307", "I"), ("8471", "I")} and got["3307", "I"].startswith("3307 Combs")
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 7, "z")], "k string, s int, v string")
    assert sorted((r.k, r.t, r.v) for r in lookup.as_of(left, right, ["k"], "t", "s", ["v"]).collect()) == [("a", 1, None), ("a", 5, "y"), ("b", 9, None)]
    clauses = spark.range(1).select(lookup.deciding_clauses(F.lit("All goods [other than Shaving cream]; other than shaving cream; other than soap 12")).alias("c")).first().c
    assert clauses == ["Shaving cream", "soap"]


def test_strata_and_words(spark):
    df = spark.createDataFrame([("typical", "a b c")] * 3 + [("hard", "d")], "difficulty string, t string")
    got = {r.stratum: (r.n, r.share, r.drifted, r.band) for r in composition.strata(df).collect()}
    assert got["typical"] == (3, 0.75, True, "warn") and got["hard"] == (1, 0.25, False, "good") and got["adversarial"] == (0, 0.0, True, "critical")
    w = composition.word_statistics(df, "t").first()
    assert (w.n, w.median, w.max, w.n_long) == (4, 3, 3, 0)


def test_jsonl(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    p.write_text('{"id": "gst-0001", "input": "x", "tags": ["a"]}\n\n// note\n{"id": "gst-0002", "extra": 1}\n')
    rows = jsonl.with_defaults(jsonl.read_jsonl(spark, str(p))).orderBy("pos").collect()
    assert [(r.id, r.tags, r.labelled_by) for r in rows] == [("gst-0001", ["a"], "human"), ("gst-0002", [], "human")]
    assert jsonl.read_jsonl(spark, str(tmp_path / "none")).count() == 0
    sha, n = jsonl.fingerprint(spark, str(p))
    assert len(sha) == 64 and n == 3 and jsonl.fingerprint(spark, str(tmp_path / "none")) == ("", 0)
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n{broken\n')
    with pytest.raises(Exception, match="bad.jsonl:2"):
        jsonl.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_runs(spark, tmp_path):
    base = {"run_id": "r1", "model_key": "m", "model_id": "i", "provider": "p", "started_at": "2026-01-02", "summary": {"label_acc": 0.5}, "cost": {"calls": 1}, "rows": [{"id": "a", "correct": True}]}
    (tmp_path / "a.json").write_text(json.dumps(base, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(base | {"run_id": "r2", "started_at": "2026-01-03"}))
    (tmp_path / "c.json").write_text(json.dumps({"other": 1}))
    got = jsonl.newest_first(jsonl.read_runs(spark, str(tmp_path))).collect()
    assert [r.run_id for r in got] == ["r2", "r1"] and got[0].summary["label_acc"] == "0.5"
    (tmp_path / "d.json").write_text(json.dumps({k: v for k, v in base.items() if k != "provider"}))
    with pytest.raises(Exception, match="no provider"):
        jsonl.read_runs(spark, str(tmp_path)).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    path = f"{tmp_path}/pool"
    sinks.append_jsonl(df, path)
    assert not sinks.rewrite(df, path) and sinks.rewrite(df.where("x = 1"), path)
    assert spark.read.json(path).count() == 1 and spark.read.json(f"{path}.bak").count() == 2
    page = sinks.leaderboard_html(spark.createDataFrame([("<m>", 0.5, 1)], "model_key string, acc double, rank int"))
    assert "&lt;m&gt;" in page
    assert len(sinks.new_run_id()) == 16


def test_models(spark):
    runs_ = spark.createDataFrame([("opus-5",)], "model_key string")
    assert models.with_models(runs_, models.models(spark)).first().usd_in_per_m == 5.0
    with pytest.raises(Exception, match="unknown model"):
        models.with_models(spark.createDataFrame([("zz",)], "model_key string"), models.models(spark)).collect()


def test_fetch_retries():
    import io
    import urllib.error

    calls, waits = [], []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", {}, None)
        return io.BytesIO(b"ok")

    assert web.fetch("http://x", opener=opener, sleep=waits.append) == b"ok"
    assert 5 <= waits[0] <= 8 and 10 <= waits[1] <= 13

    def refuse(url, timeout):
        raise urllib.error.HTTPError(url, 404, "no", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        web.fetch("http://x", opener=refuse, sleep=waits.append)

    def down(url, timeout):
        raise urllib.error.URLError("down")

    with pytest.raises(web.Unavailable):
        web.fetch("http://x", retries=2, opener=down, sleep=waits.append)


def test_env():
    assert jsonl.parse_env("# c\nexport A='x y'\nB=\nC=\"1\"\nbad\n") == {"A": "x y", "C": "1"}


def test_manifest(spark, tmp_path):
    (tmp_path / "doc.txt").write_text("the   rate is five")
    facts = jsonl.file_facts(spark, f"{tmp_path}/doc.txt")
    sha = facts.first().sha256
    m = {"documents": [{"file": "doc.txt", "bytes": 18, "sha256": sha, "must_contain": ["rate is", "six"]}, {"file": "gone.txt", "must_contain": ["x"]}]}
    (tmp_path / "m.json").write_text(json.dumps(m))
    got = {r.file: (r.missing, r.wrong_size, r.wrong_hash, r.passages_missing) for r in validation.verify_documents(jsonl.read_manifest(spark, f"{tmp_path}/m.json"), facts).collect()}
    assert got == {"doc.txt": (False, False, False, 1), "gone.txt": (True, False, False, 0)}


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = runs.read_events(spark, "/root/testdata/sf0.001")
    q = runs.latest(stream).writeStream.outputMode("complete").format("memory").queryName("latest_t").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    want = {r.event_type: r.m for r in events.groupBy("event_type").agg(F.max(F.struct("ts", "event_id")).alias("m")).collect()}
    assert {r.event_type: (r.ts, r.event_id) for r in spark.table("latest_t").collect()} == {k: (m.ts, m.event_id) for k, m in want.items()}


def test_replayed_models(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, prompt string")
    got = runs.call_models(prompts, lambda p: {"text": p.upper(), "n": len(p)}, "id long, text string, n long").collect()
    assert sorted(tuple(r) for r in got) == [(1, "A", 1), (2, "BB", 2)]
