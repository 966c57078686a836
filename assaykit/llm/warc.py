"""WARC archives with an index of byte ranges, and reads that follow the index.

Each record is a gzip member of its own, so a range of the file can be read alone. Archives are written
in two passes over bytes, none of which is shuffled. First every page becomes a response in a draft
archive, and the index tells where, with its digest. Equal payloads are found by the index alone. Then
draft archives are read in coalesced ranges, in order: members that stay are copied as they are, pages
that repeat another's payload become revisits in their place. A task writes its records to files that
no other task or attempt touches and returns the index rows of exactly these; a lost task's files are
never referred to. Reads take index rows, sort them by file and offset and join ranges that lie close
together into one read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import bound_batches, drop, forget, kept, shared_dir, table, text_slices
from assaykit.shared import passing

FILE_BYTES = 64 << 20
#: Ranges with smaller gaps are read at once, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 256 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in ({"WARC-Type": kind, "WARC-Date": DATE} | fields | {"Content-Length": str(len(block))}).items())
    return gzip.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + END, 6, mtime=0)


def page_record(page_id: int | None, url: str | None, size: int, digest: str, payload: bytes | None, refers_to: int | None = None) -> bytes:
    """A response, or a revisit (no payload) that has the HTTP head alone. The head tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = {"WARC-Record-ID": record_id(page_id), "WARC-Target-URI": quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url else f"urn:page:{page_id}", "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if payload is None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page": str(refers_to)}
    return _record("revisit" if payload is None else "response", fields, http if payload is None else http + payload)


class _Archives:
    """Archive files of one task, under a folder; each begins with a warcinfo record and ends after FILE_BYTES."""

    def __init__(self, path: str):
        self.store, self.folder = pa.fs.FileSystem.from_uri(path)
        self.store.create_dir(self.folder, recursive=True)
        self.out, self.name, self.at = None, "", 0

    def put(self, data: bytes) -> tuple[str, int]:
        """Writes a record; the file's name and its offset there."""
        if self.out is None or self.at >= FILE_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.put(_record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _fields(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])


def parse_record(data: bytes) -> dict:
    """A page's record: its fields, HTTP head's fields, and payload (None for a revisit)."""
    head, _, rest = gzip.decompress(data).partition(END)
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != END:
        raise ValueError("the record doesn't end where its length says")
    http, _, payload = block.partition(END)
    return {"warc": fields, "http": _fields(http), "payload": None if fields["WARC-Type"] == "revisit" else payload}


_INDEX = {"page_id": "long", "url": "string", "payload_bytes": "long", "digest": "string", "record_type": "string", "refers_to": "long", "file": "string", "offset": "long", "length": "long"}
_KINDS = {"long": pa.int64(), "string": pa.string()}


def _rows_of(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, _KINDS[t]) for x, t in zip(zip(*found, strict=True), _INDEX.values(), strict=True)], names=list(_INDEX))


def _in_order(rows: DataFrame) -> DataFrame:
    """Index rows dealt by stretches of files, each in the order of its bytes."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")


def _stretches(batch: pa.RecordBatch, file: int, offset: int, length: int):
    """(file, offsets, lengths, rows, from, to) of each coalesced read over rows sorted by file and offset."""
    files = batch.column(file).to_pylist()
    cuts = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            offsets, lengths = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in (offset, length))
            for a, b, start, end in spans(offsets, lengths):
                yield files[lo], offsets[a:b], lengths[a:b], range(lo + a, lo + b), start, end


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) under path; returns the index, itself written.

    Index: page_id, url, payload_bytes, digest, record_type, refers_to, file, offset, length. Of rows
    whose payloads are equal and have least_bytes at least, the one with the smallest page_id is a
    response and others are revisits of it; rows that share that id are all responses. A null html is
    an empty payload. Rows with a null id revisit an equal payload that has an id, else they are
    responses. A null url stays null in the index. Other columns are left out. No rows: empty index.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    schema = ", ".join(f"{c} {t}" for c, t in _INDEX.items())
    draft = shared_dir(spark, "warc-draft")

    def responses(batches):
        archives = _Archives(draft)
        for batch in batches:
            for lo, hi in text_slices(batch, 2):
                found = []
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.slice(lo, hi - lo).columns), strict=True):
                    payload = (html or "").encode()
                    digest = digest32(payload)
                    data = page_record(page_id, url, len(payload), digest, payload)
                    found.append((page_id, url, len(payload), digest, "response", None, *archives.put(data), len(data)))
                yield _rows_of(found)
        archives.close()

    def settled(batches):
        archives = _Archives(path)
        store, folder = pa.fs.FileSystem.from_uri(draft)
        name, file = None, None
        for batch in batches:
            facts = list(zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True))
            live = batch.filter(pa.compute.equal(batch.column(4), "response"))
            kept_at = pa.compute.indices_nonzero(pa.compute.equal(batch.column(4), "response")).to_pylist()
            found: list = [None] * len(facts)
            done = 0

            def revisits(until: int):
                for k in range(done, until):
                    page_id, url, size, digest, kind, refers_to = facts[k]
                    if kind == "revisit":
                        data = page_record(page_id, url, size, digest, None, refers_to)
                        found[k] = (page_id, url, size, digest, kind, refers_to, *archives.put(data), len(data))

            for own, offsets, lengths, rows, start, end in _stretches(live, 6, 7, 8):
                if own != name:
                    name, file = own, store.open_input_file(f"{folder}/{own}")
                data = file.read_at(end - start, start)
                for offset, length, row in zip(offsets, lengths, rows, strict=True):
                    k = kept_at[row]
                    revisits(k)
                    member = data[offset - start : offset - start + length]
                    found[k] = (*facts[k], *archives.put(member), length)
                    done = k + 1
            revisits(len(facts))
            if found:
                yield _rows_of(found)
        archives.close()

    first = kept(pages.select("page_id", "url", "html").mapInArrow(responses, schema), "warc-draft-index")
    twice = first.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first")
    marked = first.join(twice, (F.col("digest") == F.col("of")) & (F.col("payload_bytes") >= least_bytes), "left")
    marked = marked.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    marked = marked.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")).select(*_INDEX)
    index = kept(_in_order(marked).mapInArrow(settled, schema), "warc-index")
    forget(first)
    drop(spark, draft)
    return index


def spans(offsets: list[int], lengths: list[int], gap: int = GAP_BYTES, most: int = READ_BYTES):
    """(first row, row after the last, from, to) of reads over ranges sorted by offset."""
    first = 0
    for k in range(1, len(offsets) + 1):
        end = offsets[k - 1] + lengths[k - 1]
        if k == len(offsets) or offsets[k] - end > gap or offsets[k] + lengths[k] - offsets[first] > most:
            yield first, k, offsets[first], end
            first = k


def read_archives(index: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """The records that index rows point at, as they stand in the archives.

    Returns page_id, payload (null for revisits or without payloads), payload_bytes, payload_digest,
    record_type, refers_to. A response's length and digest are computed from its bytes and held
    against its fields; a mismatch raises. A revisit's come from its fields. Index rows that repeat are
    read each; null ids stay null; an empty index has no records.
    """
    bound_batches(index.sparkSession)
    ids = pa.int64()
    names = ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [ids, pa.string(), ids, pa.string(), pa.string(), ids]

    def run(batches):
        store, folder = pa.fs.FileSystem.from_uri(path)
        name, file = None, None
        for batch in batches:
            for own, offsets, lengths, _, start, end in _stretches(batch, 0, 1, 2):
                if own != name:
                    name, file = own, store.open_input_file(f"{folder}/{own}")
                data, found = file.read_at(end - start, start), []
                for offset, length in zip(offsets, lengths, strict=True):
                    r = parse_record(data[offset - start : offset - start + length])
                    digest, n = r["warc"]["WARC-Payload-Digest"].removeprefix("sha1:"), int(r["http"]["Content-Length"])
                    if r["payload"] is not None and (digest32(r["payload"]) != digest or len(r["payload"]) != n):
                        raise ValueError(f"the payload at {offset} of {name} isn't what was written")
                    page, refers = r["warc"].get("X-Page-Id"), r["warc"].get("X-Refers-To-Page")
                    found.append((None if page is None else int(page), r["payload"].decode() if payloads and r["payload"] is not None else None, n, digest, r["warc"]["WARC-Type"], None if refers is None else int(refers)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    ranges = _in_order(index.select("file", "offset", "length"))
    return ranges.mapInArrow(run, "page_id long, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Every row of pages, written and read back; the archives go with the session. Nulls, empty and repeated pages: see write_archives."""
    path = shared_dir(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), path)
    passing(spark, path)
    return read_archives(index, path, payloads=False).drop("payload")


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), f AS (
  SELECT sha, min(page_id) AS first FROM p GROUP BY sha
), b AS (
  SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, CAST(CAST(unhex(p.sha) AS BIT) AS VARCHAR) AS s, f.first
  FROM p JOIN f ON p.sha = f.sha
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(substr(s, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(s, CAST(5 * i + 2 AS INT), 1) AS INT)
    + 4 * CAST(substr(s, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(s, CAST(5 * i + 4 AS INT), 1) AS INT)
    + CAST(substr(s, CAST(5 * i + 5 AS INT), 1) AS INT) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM b
"""
