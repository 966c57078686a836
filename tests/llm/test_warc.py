import gzip
import random

import pytest

from assaykit.llm.common import shared_dir
from assaykit.llm.queries import SQL
from assaykit.llm.warc import OP10_SQL, digest32, op10_warc, parse_record, read_archives, spans, write_archives


def plain(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = min(same, default=None) if len(data) >= least else None
        refers = first if first is not None and first != i else None
        out.append((i, len(data), digest32(data), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


ROWS = [(5, "http://a/é b\r\nx", "<p>é\r\n\r\n</p>"), (2, None, "<p>é\r\n\r\n</p>"), (9, "u", None), (7, "u", ""), (7, "u", ""), (None, "u", "solo"), (None, "v", ""), (1, "w", "WARC/1.1\r\n" * 3000), (3, "x", "é" * 400_000)]


@pytest.mark.parametrize("least", [0, 1, 5000])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, sha int")
    path = shared_dir(spark, "warc-test")
    index = write_archives(pages, path, least)
    got = read_archives(index, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain(ROWS, least)
    html = {i: h or "" for i, _, h in ROWS}
    assert all(r.payload == html[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    one = read_archives(index.where("page_id = 3"), path).collect()
    assert [len(r.payload) for r in one] == [400_000]
    assert {r.url for r in index.collect()} == {u for _, u, _ in ROWS}


def test_files_are_whole_gzip_members(spark, tmp_path):
    index = write_archives(spark.createDataFrame(ROWS, "page_id long, url string, html string"), f"file://{tmp_path}").collect()
    for name in {r.file for r in index}:
        data = (tmp_path / name).read_bytes()
        own = sorted((r for r in index if r.file == name), key=lambda r: r.offset)
        assert all(a.offset + a.length == b.offset for a, b in zip(own, own[1:], strict=False)) and own[-1].offset + own[-1].length == len(data)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert all(parse_record(data[r.offset : r.offset + r.length])["warc"]["WARC-Type"] == r.record_type for r in own)


def test_no_page_is_shuffled_and_copies_leave_no_payload(spark, tmp_path):
    """A third of the pages are one page: each payload stands once in the archives, pages keep their order."""
    rows = [(k, f"u{k}", "the same page " * 500 if k % 3 == 0 else f"page {k} " + "x" * (k * 37 % 5000)) for k in range(600)]
    index = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), f"file://{tmp_path}")
    got = index.collect()
    assert sorted((r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in got) == sorted(plain(rows), key=lambda r: r[0])
    data = b"".join(gzip.decompress((tmp_path / name).read_bytes()) for name in {r.file for r in got})
    assert data.count(b"the same page " * 500) == 1 and data.count(b"WARC-Type: revisit") == 199
    assert {p.name for p in tmp_path.iterdir() if p.suffix == ".gz"} >= {r.file for r in got}


def test_spans():
    assert list(spans([0, 10, 500, 505], [10, 5, 5, 100], gap=50, most=1000)) == [(0, 2, 0, 15), (2, 4, 500, 605)]
    assert list(spans([0, 10, 20], [10, 10, 10], gap=0, most=20)) == [(0, 2, 0, 20), (2, 3, 20, 30)]
    rng = random.Random(1)
    lengths = [rng.randrange(1, 50) for _ in range(200)]
    offsets = [sum(lengths[:k]) for k in range(200)]
    got = list(spans(offsets, lengths, 10, 300))
    assert [k for a, b, *_ in got for k in range(a, b)] == list(range(200)) and all(e - s <= 300 for *_, s, e in got)


def test_no_rows(spark):
    path = shared_dir(spark, "warc-test")
    index = write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert index.count() == read_archives(index, path).count() == 0


def test_against_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    want = con.execute(OP10_SQL).fetchall()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = [tuple(r) for r in op10_warc(spark, d).select(*names).collect()]
    assert sorted(got) == sorted(want) and SQL["op10_warc"] == OP10_SQL


def test_wrong_bytes_are_seen():
    with pytest.raises(ValueError):
        parse_record(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx\r\n\r\n"))
