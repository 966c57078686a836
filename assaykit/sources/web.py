"""HTTP sources: fetching with retries, and a paged API as a Spark data source, read at once or as a stream."""

from __future__ import annotations

import http.client
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from assaykit.sources.runfiles import content, delete, names, put


class Unavailable(RuntimeError):
    """A server kept refusing."""


def fetch(url: str, retries: int = 6, timeout: int = 90, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """GET a URL. 429 and 5xx wait min(60, 5 2^k) + U(0, 3) s, broken connections and cut answers 2^k + U(0, 1) s; other codes raise at once."""
    for k in range(retries):
        try:
            with opener(url, timeout=timeout) as got:
                return got.read()
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500:
                raise
            wait = min(60, 5 * 2**k) + random.uniform(0, 3)
        except (urllib.error.URLError, TimeoutError, ConnectionError, http.client.HTTPException):
            wait = 2**k + random.uniform(0, 1)
        if k + 1 < retries:
            sleep(wait)
    raise Unavailable(f"{url}: gave up after {retries} tries")


def fetch_text(url: str, **how) -> str:
    """A URL's text; bytes that aren't UTF-8 are replaced."""
    return fetch(url, **how).decode("utf-8", errors="replace")


def fetch_json(url: str, **how) -> dict:
    """A URL's JSON; anything else raises Unavailable."""
    try:
        return json.loads(fetch_text(url, **how))
    except json.JSONDecodeError as e:
        raise Unavailable(f"{url}: not JSON: {e}") from e


class PagedApi(DataSource):
    """spark.read and spark.readStream.format("paged_api"): records of a paged JSON API, one partition a page.

    Options: url (of {page}, {size} and, if the server can leave columns out, {fields}), pages (the last
    one; a stream without it goes on until a page is empty), first, size, field (of the array), columns
    (names that the server is asked for, each with a type of string, long, double or boolean after a
    colon, string by default; they become columns in place of the whole record), retries. What the server can
    filter belongs in the url, or is named by equals, least and most: `column=parameter`, comma-separated, for
    parameters that keep exactly the records whose column equals, is at least, or is at most a value.
    A read with any of these, or with push=true, turns such filters into the query string, reads only the
    pages that filters on `page` leave, and has Spark check all others. Spark allows that with
    spark.sql.python.filterPushdown.enabled alone.

    A read fails if a page does: what lacks pages must not look whole. An empty page ends its partition
    without rows. A stream stops before the first page that fails or is empty, and goes on there when
    it is started again: see PageStream.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        columns = _columns(dict(self.options))
        return "page int, position int, " + (", ".join(f"`{c}` {kind}" for c, kind in columns.items()) if columns else "record string")

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        pushing = options.get("push") == "true" or any(options.get(x) for x in ("equals", "least", "most"))
        return (_PushingReader if pushing else _PageReader)(options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(dict(self.options))


_KINDS = {"string": lambda v: v if isinstance(v, str) else json.dumps(v), "long": int, "double": float, "boolean": bool}


def _columns(options: dict) -> dict[str, str]:
    """Names of columns and their types."""
    out = {}
    for c in options.get("columns", "").split(","):
        name, _, kind = c.strip().partition(":")
        if name:
            out[name] = kind or "string"
            if out[name] not in _KINDS:
                raise ValueError(f"{name}: no type {kind}")
    return out


def _named(options: dict, which: str) -> dict[str, str]:
    return dict(x.strip().split("=", 1) for x in options.get(which, "").split(",") if x.strip())


def _url(options: dict, page: int, more: list[tuple[str, str]] = ()) -> str:
    url = options["url"].format(page=page, size=options.get("size", "100"), fields=",".join(_columns(options)))
    return url + ("&" if "?" in url else "?") + urllib.parse.urlencode(more) if more else url


def _records(options: dict, body: dict) -> list[dict]:
    return body.get(options.get("field", "products")) or []


def _rows(options: dict, page: int, body: dict):
    columns = _columns(options)
    for k, record in enumerate(_records(options, body)):
        if not columns:
            yield page, k, json.dumps(record)
        else:
            yield page, k, *(None if record.get(c) is None else _KINDS[kind](record[c]) for c, kind in columns.items())


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.more, self.pages = options, [], range(int(options.get("first", "1")), int(options.get("pages", "1")) + 1)

    def partitions(self):
        return [InputPartition(k) for k in self.pages]

    def read(self, partition):
        body = fetch_json(_url(self.options, partition.value, self.more), retries=int(self.options.get("retries", "6")))
        yield from _rows(self.options, partition.value, body)


class _PushingReader(_PageReader):
    def pushFilters(self, filters):
        """Keep what the server or the choice of pages does whole; what they do in part, or not at all, Spark does too."""
        equals, least, most = (_named(self.options, x) for x in ("equals", "least", "most"))
        for f in filters:
            column = getattr(f, "attribute", ())
            name, value = column[0] if len(column) == 1 else "", getattr(f, "value", None)
            if name == "page" and isinstance(f, tuple(_PAGES)):
                self.pages = [p for p in self.pages if _PAGES[type(f)](p, value)]
                continue
            told, whole = None, False
            if value is not None and not isinstance(value, tuple):
                if isinstance(f, EqualTo) and name in equals:
                    told, whole = equals[name], True
                elif isinstance(f, GreaterThan | GreaterThanOrEqual) and name in least:
                    told, whole = least[name], isinstance(f, GreaterThanOrEqual)
                elif isinstance(f, LessThan | LessThanOrEqual) and name in most:
                    told, whole = most[name], isinstance(f, LessThanOrEqual)
            if told and told not in dict(self.more):
                self.more.append((told, str(value).lower() if isinstance(value, bool) else str(value)))
                if whole:
                    continue
            yield f


_PAGES = {
    EqualTo: lambda p, v: p == v,
    GreaterThan: lambda p, v: p > v,
    GreaterThanOrEqual: lambda p, v: p >= v,
    LessThan: lambda p, v: p < v,
    LessThanOrEqual: lambda p, v: p <= v,
    In: lambda p, v: p in v,
}


class PageStream(DataSourceStreamReader):
    """Pages in order, each handed on once; an offset is the next page.

    More options: spool (a folder that driver and executors share, beside the query's checkpoint),
    batch (pages of a micro-batch, 8), together (requests at a time, 1), delay (seconds between requests of
    one page after another, 0). The driver's reader fetches, for the server's patience bounds a collection, not
    Spark; it spools what it gets, and executors parse that. So a micro-batch that is run again reads the same bytes,
    whatever the server says by then, and asks it for nothing. Spooled pages go once Spark is done with them.

    The first page that fails or is empty ends the run: told in spool/stopped.json (see stopped),
    asked for again when the query is started again.
    """

    def __init__(self, options: dict):
        self.options, self.spool, self.stop_told = options, options["spool"].rstrip("/"), False

    def initialOffset(self) -> dict:
        return {"page": int(self.options.get("first", "1"))}

    def _next(self) -> int:
        """The first page that isn't spooled and never was."""
        marks = [int(n.removeprefix("next-")) for n in names(self.spool) if n.startswith("next-")]
        return max(marks, default=int(self.options.get("first", "1")))

    def _page(self, page: int) -> dict | None:
        """Fetch and spool a page; None if it is empty."""
        body = fetch_json(_url(self.options, page), retries=int(self.options.get("retries", "6")))
        if not _records(self.options, body):
            return None
        put(f"{self.spool}/page-{page:012d}.json", json.dumps(body).encode())
        return body

    def _stop(self, page: int, reason: str) -> None:
        self.stop_told = True
        put(f"{self.spool}/stopped.json", json.dumps({"page": page, "reason": reason}).encode())

    def latestOffset(self) -> dict:
        page = first = self._next()
        last = min(first + int(self.options.get("batch", "8")), int(self.options.get("pages", str(1 << 30))) + 1)
        together = int(self.options.get("together", "1"))
        while page < last and not self.stop_told:
            some = range(page, min(page + together, last))
            with ThreadPoolExecutor(together) as pool:
                for p, got in [(p, pool.submit(self._page, p)) for p in some]:
                    try:
                        if not self.stop_told and got.result() is None:
                            self._stop(p, "empty")
                    except Exception as e:  # the run ends here; the next one asks again
                        if not self.stop_told:
                            self._stop(p, f"{type(e).__name__}: {e}")
                    if not self.stop_told:
                        page = p + 1
            if page < last and not self.stop_told:
                time.sleep(float(self.options.get("delay", "0")))
        if page > first:
            put(f"{self.spool}/next-{page:012d}", b"")
        return {"page": page}

    def partitions(self, start: dict, end: dict):
        return [InputPartition(p) for p in range(start["page"], end["page"])]

    def read(self, partition):
        data = content(f"{self.spool}/page-{partition.value:012d}.json")
        if data is None:  # somebody cleared the spool: the server is asked again
            body = fetch_json(_url(self.options, partition.value), retries=int(self.options.get("retries", "6")))
        else:
            body = json.loads(data)
        yield from _rows(self.options, partition.value, body)

    def commit(self, end: dict) -> None:
        for name in names(self.spool):
            kind, _, number = name.removesuffix(".json").partition("-")
            if kind == "page" and int(number) < end["page"] or kind == "next" and int(number) < min(end["page"], self._next()):
                delete(f"{self.spool}/{name}")


def stopped(spool: str) -> dict | None:
    """Why the last run of a stream ended: its page, and `empty` or the error. None if none ended by itself."""
    data = content(f"{spool.rstrip('/')}/stopped.json")
    return None if data is None else json.loads(data)


def collect_pages(spark: SparkSession, options: dict[str, str], checkpoint: str, land: Callable[[DataFrame, int], None]) -> dict | None:
    """Run a stream of pages until it stops by itself, giving each micro-batch to `land`; why it stopped (None: at the last page).

    The stream's progress is kept in the folder `checkpoint`, its spooled pages in checkpoint/spool. Called
    again, also after a crash, it goes on at the page where it stopped. A micro-batch may come again after
    a crash, with the same rows and number: `land` must take each once, as pool.appender does.
    """
    spark.dataSource.register(PagedApi)
    spool = f"{checkpoint.rstrip('/')}/spool"
    delete(f"{spool}/stopped.json")
    pages = spark.readStream.format("paged_api").options(**options, spool=spool).load()
    query = pages.writeStream.foreachBatch(land).option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stopped(spool)
