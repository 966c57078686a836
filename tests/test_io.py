"""Sources and sinks: paged APIs, line-wise JSON lines, documents, reports, runners, environment."""

import http.client
import io
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from assaykit.functions import answers
from assaykit.operators import agreement
from assaykit.sources import jsonl, sinks, web
from assaykit.streaming import runs


@pytest.fixture
def server():
    asked = []

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            page = int(self.path.split("page=")[1].split("&")[0])
            body = b"<html>" if page == 9 else json.dumps({"products": [{"code": f"{page}-{k}", "name": None if k else "soap", "tags": ["a"]} for k in range(2)] if page < 3 else []}).encode()
            self.send_response(404 if page == 8 else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/search?page={{page}}&page_size={{size}}&fields={{fields}}", asked
    s.shutdown()


def test_paged_api(spark, server):
    url, asked = server
    spark.dataSource.register(web.PagedApi)
    whole = spark.read.format("paged_api").options(url=url, pages="3", size="2").load()
    assert sorted((r.page, r.position, json.loads(r.record)["code"]) for r in whole.collect()) == [(1, 0, "1-0"), (1, 1, "1-1"), (2, 0, "2-0"), (2, 1, "2-1")]
    some = spark.read.format("paged_api").options(url=url, pages="2", columns="code, name,tags").load()
    assert sorted(tuple(r) for r in some.collect())[0] == (1, 0, "1-0", "soap", '["a"]') and some.columns == ["page", "position", "code", "name", "tags"]
    assert any("fields=code,name,tags" in p for p in asked)
    for pages in ("8", "9"):  # a page that isn't there, one that isn't JSON: no result that lacks pages
        with pytest.raises(Exception):
            spark.read.format("paged_api").options(url=url.replace("page={page}", f"page={pages}"), pages="1", retries="1").load().collect()


def test_fetch_of_cut_answers_and_json():
    calls = []

    def cut(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise http.client.IncompleteRead(b"x")
        return io.BytesIO(b'{"a": "\xff"}')

    assert web.fetch_json("http://x", opener=cut, sleep=lambda s: None) == {"a": "�"} and len(calls) == 3
    with pytest.raises(web.Unavailable):
        web.fetch_json("http://x", opener=lambda url, timeout: io.BytesIO(b"<html>"))


def test_lines_of_files_in_many_splits(spark, tmp_path):
    rows = [f'{{"id": "gst-{k:04d}", "input": "{"x" * (k % 90)}"}}' if k % 7 else ["", "  ", "// note"][k % 3] for k in range(3000)]
    for name, part in (("a", rows[:2000]), ("b", rows[2000:])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(part) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = jsonl.read_pool(spark, str(tmp_path), jsonl.EXAMPLE).collect()
        want = [(n, k, json.loads(x)["id"]) for n, part in (("a.jsonl", rows[:2000]), ("b.jsonl", rows[2000:])) for k, x in enumerate(part) if x.strip() and not x.startswith("//")]
        assert sorted((r.file, r.line, r.id) for r in got) == want
        (tmp_path / "a.jsonl").write_text("\n".join([*rows[:1500], "{broken", *rows[1500:]]))
        with pytest.raises(Exception, match="a.jsonl:1501"):
            jsonl.read_pool(spark, str(tmp_path), jsonl.EXAMPLE).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_documents_and_counts(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, n int")
    assert sinks.append_jsonl(df, f"{tmp_path}/rows") == 2 and sinks.append_jsonl(df.limit(1), f"{tmp_path}/rows") == 1
    assert spark.read.json(f"{tmp_path}/rows").count() == 3
    path = sinks.save_run(df.limit(1), str(tmp_path))
    assert path.endswith("/r1.json") and json.loads((tmp_path / "r1.json").read_text()) == {"run_id": "r1", "n": 1}
    with pytest.raises(Exception):
        sinks.save_run(df.limit(1), str(tmp_path))
    with pytest.raises(ValueError):
        sinks.save_document(df, f"{tmp_path}/two.json")
    assert spark.range(1).select(sinks.run_date(F.lit("2026-01-02T03:04:05Z")).alias("d")).first().d == "2026-01-02"


def test_rewrite_keeps_a_copy(spark, tmp_path):
    path = f"{tmp_path}/pool"
    for n in (3, 2, 1):
        changed = sinks.rewrite(spark.range(n), path) if n < 3 else sinks.append_jsonl(spark.range(n), path)
        assert changed
    assert [spark.read.json(f"{path}{end}").count() for end in ("", ".bak")] == [1, 2]
    assert not sinks.rewrite(spark.range(5), path, dry_run=True) and spark.read.json(path).count() == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["pool", "pool.bak"]


def test_probe_document(spark, tmp_path):
    answers_ = spark.createDataFrame([("a", 1, "5"), ("a", 2, "5"), ("b", 1, "18"), ("b", 2, None), ("c", 1, "3"), ("c", 2, "3")], "item string, run int, answer string")
    gold = spark.createDataFrame([("a", "5"), ("b", "18")], "item string, gold string")
    summaries = spark.createDataFrame([(1, 0.5, 0.25), (2, 0.75, 0.25)], "run int, label_acc double, heading_acc double")
    whole = agreement.aggregate_runs(summaries, answers_, gold, ["label_acc", "heading_acc"])
    doc = sinks.probe_document(whole, summaries, answers_, "not the golden set", "m", "mid", "v1", "t0", "t1")
    got = json.loads(open(sinks.save_document(doc, f"{tmp_path}/probe.json")).read())
    assert got["NOT_THE_GOLDEN_SET"] == "not the golden set" and got["summary"] == {"label_acc": 0.75, "heading_acc": 0.25} and len(got["rows"]) == 3 and [r["run"] for r in got["all_runs"]] == [1, 2]
    a = got["aggregate"]
    assert a["runs"] == 2 and a["metrics"]["label_acc"] == {"mean": 0.625, "min": 0.5, "max": 0.75, "range": 0.25, "runs": [0.5, 0.75]}
    assert {k: a["self_agreement"][k] for k in ("examples", "answered_identically_every_run", "unstable", "rate")} == {"examples": 3, "answered_identically_every_run": 2, "unstable": 1, "rate": 0.6667}
    [detail] = a["self_agreement"]["detail"]
    assert detail["item"] == "b" and detail["gold"] == "18" and detail["answers"][0] == "18" and a["majority_vote_acc"] == 0.6667


def test_board_and_reports(spark):
    ranked = spark.createDataFrame([(1, "m", "", "mid", "t", 0.5, "old", "2026-01-02T00:00:00Z"), (2, "n", "served", "mid", "t", 0.25, "new", "2026-01-03T00:00:00Z")], "rank int, model_key string, served_model_id string, model_id string, tier string, label_acc double, dataset_sha string, started_at string")
    rows = sinks.board_rows(ranked, "new").collect()
    assert [(r.served_model_id, r.run_date, r.drifted) for r in rows] == [("mid", "2026-01-02", True), ("served", "2026-01-03", False)]
    assert sinks.leaderboard_html(sinks.board_rows(ranked, "new")).count("<tr>") == 3
    pairs = spark.createDataFrame([("1", "PASS", "PASS", "ok"), ("2", "FAIL", "PASS", None), ("3", "FAIL", "FAIL", "x"), ("4", "FAIL", "PASS", "y")], "example_id string, human string, judge string, reason string")
    note = sinks.judge_markdown(pairs, agreement.cohen_kappa(pairs, "human", "judge"), agreement.confusion(pairs, "human", "judge"), agreement.directions(pairs), "j", "v1")
    assert "too lenient" in note and "`2` human FAIL, judge PASS" in note and "reason: y" in note
    none = pairs.limit(0)
    assert "No pairs" in sinks.judge_markdown(none, agreement.cohen_kappa(none, "human", "judge"), agreement.confusion(none, "human", "judge"), agreement.directions(none), "j", "v1")
    twice = spark.createDataFrame([("a", "5", "5", "t"), ("b", "5", "18", "u" * 300)], "id string, gold_label string, label string, input string")
    report = sinks.self_agreement_markdown({"label": agreement.cohen_kappa(twice, "gold_label", "label")}, agreement.confusion(twice, "gold_label", "label"), twice.where("gold_label <> label"), 0.85)
    assert "is below 85%" in report and "`b` 5 -> 18" in report and "u" * 241 not in report


def test_runners(spark):
    class Echo:  # goes to the workers by value
        provider, model = "p", "m"

        def run(self, prompt, *, system=None):
            if prompt == "bad":
                raise TimeoutError("slow")
            if prompt == "worse":
                raise runs.RunnerError("no key")
            return {"text": f"{system}:{prompt}", "model": self.model, "provider": self.provider}

    schema = "id long, text string, model string, provider string, error string, latency_ms long"
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id long, prompt string")
    got = {r.id: r for r in runs.call_models(df, Echo(), schema, system="s").collect()}
    assert got[1].text == "s:a" and got[1].error is None and got[2].error == "TimeoutError: slow" and got[2].text == "" and all(r.latency_ms >= 0 for r in got.values())
    with pytest.raises(Exception, match="no key"):
        runs.call_models(spark.createDataFrame([(1, "worse")], "id long, prompt string"), Echo(), schema).collect()
    assert runs.timed(lambda x: {"text": x})("y")["latency_ms"] >= 0


def test_request_bodies(spark):
    df = spark.createDataFrame([("chat_template", True), ("system_toggle", False), ("effort", True), ("none", True)], "style string, thinking boolean")
    got = [json.loads(r.b) for r in df.select(answers.request_body(F.lit("m"), F.lit("hi"), None, F.col("style"), F.col("thinking"), F.lit(9)).alias("b")).collect()]
    user = {"role": "user", "content": "hi"}
    assert got[0] == {"model": "m", "messages": [user], "max_tokens": 9, "chat_template_kwargs": {"enable_thinking": True}}
    assert got[1]["messages"] == [{"role": "system", "content": "detailed thinking off"}, user]
    assert got[2]["reasoning_effort"] == "max" and got[3] == {"model": "m", "messages": [user], "max_tokens": 9}


def test_environment_files(tmp_path):
    (tmp_path / ".env").write_text("export A=1\nB='two words'\nC=3\n")
    env = {"C": "kept", "B": ""}
    assert sorted(jsonl.load_env(str(tmp_path / ".env"), env=env)) == ["A", "B"] and env == {"A": "1", "B": "two words", "C": "kept"}
    assert "C" in jsonl.load_env(str(tmp_path / ".env"), override=True, env=env) and env["C"] == "3"
    assert jsonl.load_env(str(tmp_path / "none"), env=env) == []
