"""Collections: resumable pages, filters that the server takes, batches that land once, run files, snapshots."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from assaykit.sources import jsonl, pool, runfiles, web

RECORDS = [{"code": f"c{k:03d}", "name": None if k % 7 == 0 else f"soap {k % 5}", "price": k / 4, "stock": k % 3, "new": k % 2 == 0} for k in range(46)]


class Server:
    """Pages of RECORDS, five each, filtered as asked; `broken` pages answer 503."""

    def __init__(self):
        self.asked, self.broken = [], set()
        outer = self

        class Pages(BaseHTTPRequestHandler):
            def do_GET(self):
                q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query).items()}
                outer.asked.append(q)
                page = int(q["page"])
                some = [r for r in RECORDS if ("stock" not in q or r["stock"] == int(q["stock"])) and r["price"] >= float(q.get("price_min", 0)) and r["price"] <= float(q.get("price_max", 99))]
                body = json.dumps({"products": some[5 * page - 5 : 5 * page]}).encode()
                self.send_response(503 if page in outer.broken else 200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.options = {"url": f"http://127.0.0.1:{self.http.server_port}/search?page={{page}}", "size": "5", "columns": "code,name,price:double,stock:long,new:boolean", "retries": "1"}

    def pages(self):
        return [int(q["page"]) for q in self.asked]


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


@pytest.fixture
def pushing(spark):
    spark.dataSource.register(web.PagedApi)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


WANT = [(k // 5 + 1, k % 5, r["code"], r["name"], r["price"], r["stock"], r["new"]) for k, r in enumerate(RECORDS)]
KIND = "page int, position int, code string, name string, price double, stock long, new boolean"


def landed(spark, path):
    return sorted(tuple(r) for r in pool.read_pool_at(spark, pool.snapshot(spark, path), KIND).collect())


def test_pages_land_once_over_failures_and_restarts(spark, server, tmp_path):
    path, checkpoint = f"{tmp_path}/pool", f"{tmp_path}/run"
    options = server.options | {"batch": "2", "together": "2"}
    spark.dataSource.register(web.PagedApi)
    whole = sorted(tuple(r) for r in spark.read.format("paged_api").options(**options, pages="10").load().collect())
    assert whole == WANT
    server.asked.clear()
    server.broken = {6}
    told = web.collect_pages(spark, options, checkpoint, pool.appender(path, "shop"))
    assert told["page"] == 6 and "Unavailable" in told["reason"] and landed(spark, path) == WANT[:25]
    server.broken = set()
    add = pool.appender(path, "shop")

    def killed(df, batch):  # after its rows are in, before Spark knows
        add(df, batch)
        raise KeyboardInterrupt if batch == -1 else RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        web.collect_pages(spark, options, checkpoint, killed)
    assert landed(spark, path) == WANT[:35]
    asked = len(server.asked)

    def early(df, batch):  # before its rows are in
        raise RuntimeError("killed early")

    with pytest.raises(Exception, match="killed early"):
        web.collect_pages(spark, options, checkpoint, early)
    assert landed(spark, path) == WANT[:35]
    told = web.collect_pages(spark, options, checkpoint, add)
    assert told == {"page": 11, "reason": "empty"} and landed(spark, path) == WANT
    assert asked < len(server.asked) and all(server.pages().count(p) == 1 for p in (1, 2, 3, 4, 5, 7, 8, 9, 10))  # 6 was asked for twice, the empty one as often as the end was looked for
    assert web.collect_pages(spark, options, checkpoint, add)["reason"] == "empty" and landed(spark, path) == WANT


def test_a_stream_with_a_last_page(spark, server, tmp_path):
    path = f"{tmp_path}/pool"
    assert web.collect_pages(spark, server.options | {"pages": "3", "first": "2"}, f"{tmp_path}/run", pool.appender(path, "w")) is None
    assert landed(spark, path) == WANT[5:15] and sorted(server.pages()) == [2, 3]


@pytest.mark.parametrize(
    "condition, asked, pages",
    [
        ("stock = 1", {"stock": "1"}, 10),
        ("price >= 2.5 AND price < 9", {"price_min": "2.5", "price_max": "9.0"}, 10),
        ("stock = 2 AND name LIKE 'soap 1%' AND new", {"stock": "2"}, 10),
        ("page > 3 AND page <= 5", {}, 2),
        ("page IN (2, 9) AND price <= 100", {"price_max": "100.0"}, 2),
        ("price > 3 AND price > 4 AND (stock = 1 OR stock = 2)", {"price_min": None}, 10),
        ("name IS NULL", {}, 10),
    ],
)
def test_filters_go_to_the_server(pushing, server, condition, asked, pages):
    api = {"push": "true"} if "page" in condition and "price" not in condition else {"equals": "stock=stock", "least": "price=price_min", "most": "price=price_max"}
    got = pushing.read.format("paged_api").options(**server.options, **api, pages="10").load().where(condition)
    plain = pushing.createDataFrame(WANT, KIND).where(condition).collect()
    assert {tuple(r)[2:] for r in got.collect()} == {tuple(r)[2:] for r in plain} and plain  # a page of what the server keeps is another page
    assert len(set(server.pages())) == pages
    for k, v in asked.items():
        assert all(k in q and (v is None or q[k] == v) for q in server.asked)
    assert all(set(q) - {"page", "stock", "price_min", "price_max"} == set() for q in server.asked)


def test_batches_land_once(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/pool"
    rows = lambda lo, hi: spark.range(lo, hi).select("id", F.format_string("t%d", "id").alias("t"))
    assert pool.append_once(rows(0, 10), path, "a", 0) == 10 and pool.append_once(rows(0, 10), path, "a", 0) == 0
    assert pool.append_once(rows(10, 15), path, "b", 0) == 5 and pool.append_once(rows(0, 0), path, "a", 1) == 0
    put = pool._put
    monkeypatch.setattr(pool, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        pool.append_once(rows(15, 20), path, "a", 2)
    monkeypatch.setattr(pool, "_put", put)
    at = pool.snapshot(spark, path)
    assert at.rows == 15 and ("a", 2) not in at.batches
    assert pool.append_once(rows(15, 20), path, "a", 2) == 5
    back = pool.read_pool_at(spark, pool.snapshot(spark, path), "id long, t string")
    assert sorted(r.id for r in back.collect()) == list(range(20))
    assert pool.read_pool_at(spark, at, "id long, t string").count() == 15
    none = pool.snapshot(spark, f"{tmp_path}/none")
    assert none.number == none.rows == 0 and pool.read_pool_at(spark, none, "id long").count() == 0


def test_rewrites_and_pinned_readers(spark, tmp_path, monkeypatch):
    path, kind = f"{tmp_path}/pool", "id long, t string"
    rows = spark.range(100).select("id", F.lit("x").alias("t"))
    pool.append_once(rows, path, "a", 0)
    first = pool.snapshot(spark, path)
    reader = pool.read_pool_at(spark, first, kind)
    assert not pool.rewrite_pool(reader.where("id < 50"), first, dry_run=True) and not pool.rewrite_pool(reader.repartition(7), first)
    put = pool._put

    def crash_before(*a):
        raise RuntimeError("crash")

    def crash_after(*a):
        put(*a)
        raise RuntimeError("crash")

    monkeypatch.setattr(pool, "_put", crash_before)
    with pytest.raises(RuntimeError):
        pool.rewrite_pool(reader.where("id < 50"), first)
    monkeypatch.setattr(pool, "_put", put)
    assert pool.snapshot(spark, path) == first and reader.count() == 100
    monkeypatch.setattr(pool, "_written", lambda df, path: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        pool.rewrite_pool(reader.where("id < 50"), first)
    monkeypatch.undo()
    monkeypatch.setattr(pool, "_put", crash_after)  # the switch is made: the new rows are the pool
    with pytest.raises(RuntimeError):
        pool.rewrite_pool(reader.where("id < 50"), first)
    monkeypatch.undo()
    second = pool.snapshot(spark, path)
    assert second.rows == 50 and reader.count() == 100 and pool.backup(spark, path).rows == 100
    assert pool.append_once(rows, path, "a", 0) == 0  # a batch that the rewrite has taken in doesn't come back
    with pytest.raises(pool.Changed):
        pool.rewrite_pool(reader.where("id < 10"), first)
    pool.append_once(rows.where("id < 3"), path, "a", 1)
    with pytest.raises(pool.Changed):
        pool.rewrite_pool(pool.read_pool_at(spark, second, kind).where("id < 10"), second)
    (tmp_path / "pool" / "log" / f"{99:012d}.json").write_text("")  # a writer that died while it wrote its entry
    now = pool.snapshot(spark, path)
    assert now.rows == 53 and pool.rewrite_pool(pool.read_pool_at(spark, now, kind).where("id < 10"), now)
    assert pool.snapshot(spark, path).rows == 13 and pool.backup(spark, path).rows == 53
    assert pool.vacuum(spark, path) > 0
    assert pool.read_pool_at(spark, pool.snapshot(spark, path), kind).count() == 13 and pool.read_pool_at(spark, pool.backup(spark, path), kind).count() == 53


def test_run_files_from_executors(spark, tmp_path):
    folder = f"{tmp_path}/runs"
    run = spark.range(40).select(
        F.format_string("r%03d", "id").alias("run_id"), F.lit("m").alias("model_key"), F.lit("mid").alias("model_id"), F.lit("p").alias("provider"), F.format_string("2026-01-%02d", F.col("id") % 28 + 1).alias("started_at"),
        F.create_map(F.lit("n"), F.col("id").cast("string")).alias("summary"), F.create_map(F.lit("usd"), F.lit("0")).alias("cost"),
    ).repartition(6)
    broken = run.withColumn("notes", F.when(F.col("run_id") == "r033", F.raise_error(F.lit("task failed"))).otherwise("n"))
    with pytest.raises(Exception, match="task failed"):
        runfiles.save_runs(broken, folder)
    assert not list((tmp_path / "runs").glob("*.json")) and not list((tmp_path / "runs" / "_attempts").iterdir())
    runfiles.save_runs(run, folder)
    assert sorted(p.name for p in (tmp_path / "runs").glob("*.json")) == [f"r{k:03d}.json" for k in range(40)]
    back = jsonl.read_runs(spark, f"{folder}/*.json")
    assert sorted((r.run_id, r.summary["n"]) for r in back.collect()) == [(f"r{k:03d}", str(k)) for k in range(40)]
    runfiles.save_runs(run, folder)  # the same again changes nothing
    other = run.where("run_id = 'r005'").withColumn("provider", F.lit("q"))
    with pytest.raises(Exception, match="another content"):
        runfiles.save_runs(other, folder)
    with pytest.raises(Exception, match="occurs twice"):
        runfiles.save_runs(other.unionByName(other).withColumn("run_id", F.lit("new")), folder)
    assert json.loads((tmp_path / "runs" / "r005.json").read_text())["provider"] == "p" and not (tmp_path / "runs" / "new.json").exists()
    runfiles.save_runs(other, folder, overwrite=True)
    assert json.loads((tmp_path / "runs" / "r005.json").read_text())["provider"] == "q"
    with pytest.raises(Exception, match="can't be named"):
        runfiles.save_runs(other.withColumn("run_id", F.lit("../x")), folder)
    runfiles.save_runs(run.limit(0), f"{tmp_path}/empty")
    assert not list((tmp_path).glob("empty/*.json"))
