"""Calls made once, and chains of corrections against a walk."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, quote, urlsplit
from urllib.request import urlopen

import pytest

from assaykit.operators.validation import correction_chains
from assaykit.streaming.calls import complete_once, completions
from assaykit.streaming.runs import RunnerError


@pytest.fixture
def service():
    asked, state = [], {"fail": 0}

    class Model(BaseHTTPRequestHandler):
        def do_GET(self):
            prompt = parse_qs(urlsplit(self.path).query, keep_blank_values=True)["q"][0]
            asked.append(prompt)
            broken = prompt.startswith("busy") and asked.count(prompt) <= 2 or prompt == state.get("down")
            self.send_response(503 if broken else 200)
            self.end_headers()
            self.wfile.write(f"answer to {prompt}".encode())

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/?q=", asked, state
    s.shutdown()


def runner(url, dies=""):
    class Web:  # goes to the workers by value
        provider, model = "p", "m"

        def run(self, prompt, *, system=None):
            if dies and prompt == dies:
                raise RunnerError("lost")
            return {"text": urlopen(url + quote(prompt)).read().decode(), "tokens_in": len(prompt), "finish": "stop"}

    return Web()


def test_only_what_is_missing_is_asked(spark, tmp_path, service):
    url, asked, state = service
    table = f"{tmp_path}/calls"
    rows = [(k, f"q{k % 30}") for k in range(50)] + [(50, "busy1"), (51, "busy2"), (52, None), (53, "")]
    df = spark.createDataFrame(rows, "id long, prompt string")
    how = {"base": 0.01, "buckets": 4, "keep": 3, "retries": 3}
    state["down"] = "q7"
    got = {r.id: r for r in complete_once(df, runner(url), table, **how).collect()}
    assert len(got) == 54 and all(got[k].text == f"answer to {p or ''}" and got[k].error is None for k, p in rows if p != "q7")
    assert got[7].error and got[37].error and asked.count("q7") == 3 and asked.count("busy1") == 3 and all(asked.count(f"q{k}") == 1 for k in range(30) if k != 7) and asked.count("") == 1
    assert got[5].tokens_in == 2 and got[5].extra == '{"finish": "stop"}'
    asked.clear()
    state["down"] = None
    again = {r.id: r for r in complete_once(df, runner(url), table, **how).collect()}
    assert asked == ["q7"] and again[37].text == "answer to q7" and again[37].error is None
    asked.clear()
    assert complete_once(df, runner(url), table, **how).where("error is null").count() == 54 and asked == []
    more = complete_once(df.limit(2), runner(url), table, params={"temperature": 1}, **how)
    assert more.count() == 2 and len(asked) == 2  # other parameters are another question
    assert complete_once(df.limit(0), runner(url), table, **how).count() == 0 and completions(spark, f"{tmp_path}/none").count() == 0


def test_a_lost_task_keeps_what_it_had(spark, tmp_path, service):
    url, asked, _ = service
    table = f"{tmp_path}/calls"
    df = spark.createDataFrame([(k, f"q{k}") for k in range(40)], "id long, prompt string")
    how = {"buckets": 1, "keep": 4, "together": 1, "base": 0.0}
    with pytest.raises(Exception, match="lost"):
        complete_once(df, runner(url, dies="q25"), table, **how)
    before = set(asked)
    stored = {r.text.removeprefix("answer to ") for r in completions(spark, table).collect()}
    assert stored <= before and len(before - stored) < 4  # but for the group that broke off
    assert complete_once(df, runner(url), table, **how).where("error is null").count() == 40
    assert all(asked.count(p) == 1 for p in stored) and set(asked) == {f"q{k}" for k in range(40)}


def walk(rows):
    to = {}
    for i, p in rows:
        if i is not None:
            to[i] = min((x for x in (to.get(i), p) if x is not None), default=None)
    out = []
    for i in to:
        at, seen = i, [i]
        while to[at] in to and to[at] not in seen:
            at = to[at]
            seen.append(at)
        state = ("active" if at == i else "replaced") if to[at] is None else "dangling" if to[at] not in to else "cycle"
        out.append((i, state, None if state == "cycle" else at, None if state == "cycle" else len(seen) - 1))
    return sorted(out)


@pytest.mark.parametrize("cycles", [False, True])
def test_chains_against_a_walk(spark, cycles):
    import random

    rng = random.Random(11)
    rows = [(k, k + 1 if k < 299 else None) for k in range(300)]  # one long chain
    rows += [(1000 + k, rng.choice([None, 1000 + rng.randrange(k + 1, 400), 5000 + k, 3])) for k in range(390)]
    rows += [(None, 5), (1005, 2), (1005, None), (2000, -1)]
    if cycles:
        rows += [(3000, 3001), (3001, 3002), (3002, 3000), (3003, 3001), (3004, 3004), *((3100 + k, 3101 + k) for k in range(50)), (3150, 3120)]
    df = spark.createDataFrame(rows, "id long, deprecated_by long").repartition(4)
    got = sorted(tuple(r) for r in correction_chains(df).collect())
    assert got == walk(rows)
    assert correction_chains(df.limit(0)).count() == 0
    renamed = correction_chains(df.selectExpr("id AS _key", "deprecated_by AS state"), "_key", "state")
    assert renamed.count() == len(got)
