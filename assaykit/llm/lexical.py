"""Ranked lexical search: shards of compressed postings, merged document by document, best results merged.

The index is a written table with a row for each shard, a run of documents from one task. A shard numbers
its documents in the order of their ids, so its postings, gaps and occurrences as numbers of variable
length, are sorted by id. A search reads two narrow columns for document frequencies, then every shard
once: a heap of its terms' next documents gives the lowest one, all lists that have documents in the run
that begins there are popped and added up, and a bounded heap keeps each item's best by score, then id. A
first part of the shards is searched alone; its k-th scores are a floor for the others, which then
return only what can still be among the best.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import bound_batches, coded_words, compact, forget, kept, table, text_slices

#: A term; the same as a Java and an RE2 pattern.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Results for each item; bytes of text in a shard; documents added up at once; terms of items sent to the workers at once; the part of shards that is searched first, one in so many.
TOP, SHARD_BYTES, RUN, PAIRS, FIRST = 50, 16 << 20, 4096, 200_000, 16
#: Stands for a null id in a shard; such documents come last of equal scores.
NULL_ID = (1 << 63) - 1

_BYTES = bytes((b | 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def coded_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms of some texts (null: none) as codes, the n + 1 places where texts begin and end among them, and the distinct terms."""
    texts = compact(texts)
    data = texts.buffers()[2]
    plain = data.to_pybytes().translate(_BYTES) if data else b""
    return coded_words(pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(plain)))


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers from 0, seven bits a byte, lowest first, the last byte of each under 128; and the bytes that each takes."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        low = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[begin[has] + k] = low.astype(np.uint8) | (128 * (size[has] > k + 1)).astype(np.uint8)
    return out.tobytes(), size


def unpacked(data) -> np.ndarray:
    """The numbers of packed()."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.flatnonzero(raw < 128)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begin, np.diff(begin, append=len(raw)))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), begin)


SCHEMA = "shard long, docs long, words long, ids binary, sizes binary, terms binary, counts binary, lengths binary, postings binary"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class _Builder:
    """Documents of one shard: their ids, sizes, and (term, document, occurrences)."""

    def __init__(self):
        self.bytes, self.ids, self.sizes, self.terms, self.triples = 0, [], [], [], []

    def add(self, ids: np.ndarray, texts: pa.Array) -> None:
        codes, ends, distinct = coded_terms(texts)
        size = np.diff(ends)
        owner = np.repeat(np.arange(len(size)), size)
        pair, times = np.unique(owner * max(1, len(distinct)) + codes, return_counts=True)
        doc, code = pair // max(1, len(distinct)), pair % max(1, len(distinct))
        self.triples.append((code + sum(map(len, self.terms)), doc + sum(map(len, self.sizes)), times))
        self.terms.append(distinct.cast(pa.large_string()))
        self.ids.append(ids)
        self.sizes.append(size)
        self.bytes += int(pc.sum(pc.binary_length(texts)).as_py() or 0)

    def row(self, shard: int) -> pa.RecordBatch | None:
        """The shard's row; None without a term."""
        ids, sizes = np.concatenate(self.ids), np.concatenate(self.sizes)
        if not sizes.any():
            return None
        order = np.argsort(ids, kind="stable")
        order = order[sizes[order] > 0]
        place = np.zeros(len(ids), np.int64)
        place[order] = np.arange(len(order))
        coded = pa.concat_arrays(self.terms).dictionary_encode()
        by_name = pc.array_sort_indices(coded.dictionary).to_numpy()
        rank = np.zeros(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        code, doc, times = (np.concatenate(x) for x in zip(*self.triples, strict=True))
        term, doc = rank[coded.indices.to_numpy()[code]], place[doc]
        at = np.lexsort((doc, term))
        term, doc, times = term[at], doc[at], times[at]
        counts = np.bincount(term, minlength=len(rank))
        gaps = np.diff(doc, prepend=0)
        heads = np.cumsum(counts) - counts
        gaps[heads] = doc[heads]
        data, size = packed(np.column_stack([gaps, times]).ravel())
        lengths = np.add.reduceat(size, 2 * heads)
        names = coded.dictionary.take(pa.array(by_name)).to_pylist()
        values = [shard, len(order), int(sizes.sum()), ids[order].astype("<i8").tobytes(), packed(sizes[order])[0], "\n".join(names).encode(), packed(counts)[0], packed(lengths)[0], data]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], names=_NAMES)


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all rows whose text has a term, as a written table (SCHEMA), a row for each shard of about shard_bytes of text.

    Shards are made where the rows are read; nothing is shuffled. Null texts have no terms; rows with a
    null id, and rows that share one, are documents like others. No terms at all give no shards.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        first, made, now = TaskContext.get().partitionId() << 32, 0, _Builder()
        for batch in batches:
            ids = pc.fill_null(batch.column(0), NULL_ID).to_numpy(zero_copy_only=False)
            for lo, hi in text_slices(batch, 1):
                now.add(ids[lo:hi], batch.column(1).slice(lo, hi - lo))
                if now.bytes >= shard_bytes:
                    row, made, now = now.row(first + made), made + 1, _Builder()
                    if row is not None:
                        yield row
        if now.ids and (row := now.row(first + made)) is not None:
            yield row

    return kept(docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, SCHEMA), "postings")


class Shard:
    """A shard's row with what a search needs: gains of a term's documents are computed once for all items."""

    def __init__(self, row: dict, docs: int, words: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        size = unpacked(row["sizes"])
        if 50 * docs * int(size.max(initial=0)) < 1 << 63:
            part = (50 * docs * size) // max(1, words)
        else:
            few, code = np.unique(size, return_inverse=True)
            part = np.array([50 * docs * n // words for n in few.tolist()], np.int64)[code]
        self.length = 20 * (50 + part)
        self.terms = pa.array(row["terms"].decode().split("\n"), pa.large_string())
        self.ends = np.concatenate([[0], np.cumsum(unpacked(row["lengths"]))])
        self.postings, self._lists = row["postings"], {}

    def places(self, terms: pa.Array) -> np.ndarray:
        """Places of some terms in the shard, -1 for those that it doesn't have."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False)

    def list(self, place: int, weight: int) -> tuple[np.ndarray, np.ndarray, int]:
        """A term's documents, what each gains by it, and the most that one does."""
        if place not in self._lists:
            both = unpacked(self.postings[self.ends[place] : self.ends[place + 1]])
            docs, times = np.cumsum(both[0::2]), both[1::2]
            gain = weight * ((1_000_000_000 * times) // (1000 * times + self.length[docs]))
            self._lists[place] = (docs, gain, int(gain.max()))
        return self._lists[place]


def merge(lists: list[tuple[np.ndarray, np.ndarray, int]], ids: np.ndarray, best: list[tuple[int, int]], k: int, least: int = 1) -> None:
    """Offer a shard's documents to `best`, a heap of at most k (score, -id); scores under `least` aren't wanted."""
    if sum(x[2] for x in lists) < max(least, best[0][0] if len(best) == k else 0):
        return
    heads = [(int(docs[0]), n, 0) for n, (docs, _, _) in enumerate(lists)]
    heapq.heapify(heads)
    while heads:
        begin = heads[0][0]
        end = begin + RUN
        score = np.zeros(min(RUN, len(ids) - begin), np.int64)
        while heads and heads[0][0] < end:
            _, n, at = heapq.heappop(heads)
            docs, gain, _ = lists[n]
            to = at + int(np.searchsorted(docs[at:], end))
            score[docs[at:to] - begin] += gain[at:to]
            if to < len(docs):
                heapq.heappush(heads, (int(docs[to]), n, to))
        some = np.flatnonzero(score >= max(least, best[0][0] if len(best) == k else 0))
        if len(some) > k:  # the others can't be among the k best of this run; ids rise with places
            some = some[np.argsort(-score[some], kind="stable")[:k]]
        for s, i in zip(score[some].tolist(), ids[begin + some].tolist(), strict=True):
            if len(best) < k:
                heapq.heappush(best, (s, -i))
            elif (s, -i) > best[0]:
                heapq.heapreplace(best, (s, -i))


def _frequencies(index: DataFrame, terms: pa.Array) -> dict[int, int]:
    """Documents that hold each of some terms, by place."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for names, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = pc.fill_null(pc.index_in(sent.value, value_set=pa.array(names.decode().split("\n"), pa.large_string())), -1).to_numpy(zero_copy_only=False)
                total += np.where(place >= 0, unpacked(counts)[place], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    got = index.select("terms", "counts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in got.collect()}  # a row for each term of the block


def _searched(index: DataFrame, sent, facts: tuple[int, int], k: int) -> DataFrame:
    """item, doc_id, score: the k best of each task's shards for each item, if their score reaches the item's floor. A null id is NULL_ID.

    sent: the broadcast (terms, weights, items), an item being (its number, places of its terms, floor).
    """

    def run(batches):
        terms, weights, items = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for batch in batches:
            for n in range(len(batch)):
                shard = Shard({c: batch.column(c)[n].as_py() for c in ("ids", "sizes", "terms", "lengths", "postings")}, *facts)
                place = shard.places(terms)
                for (_, own, least), heap in zip(items, best, strict=True):
                    lists = [shard.list(int(place[t]), weights[t]) for t in own if place[t] >= 0 and weights[t] > 0]
                    if lists:
                        merge(lists, shard.ids, heap, k, least)
        rows = [(item, -i, s) for (item, _, _), heap in zip(items, best, strict=True) for s, i in heap]
        item, ids, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, ids, score)], names=["item", "doc_id", "score"])

    return index.select("ids", "sizes", "terms", "lengths", "postings").mapInArrow(run, "item long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = TOP, id_column: str = "item_id", text_column: str = "text", pairs: int = PAIRS, first: int = FIRST) -> DataFrame:
    """(id column of items, rank, doc_id, score): the k documents with the highest scores above 0 of each row of items (all, if fewer).

    Equal scores go by rising doc_id, a null one last. Rows of items that share an id, or have none,
    are answered each; a null text, or one without terms, finds nothing. Items are sent to the workers
    in blocks of about `pairs` terms, chosen by a hash, and each block reads the index twice. The result
    is written. No items or no shards give no rows.
    """
    spark = items.sparkSession
    lower = F.translate(F.col(text_column).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = items.select(F.col(id_column), F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("terms"))
    asked = kept(own.where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0]
    facts = tuple(index.agg(F.sum("docs"), F.sum("words")).first())
    parts = []
    for block in range(-(-total // pairs) if total and facts[0] else 0):
        few = asked.where(F.pmod(F.xxhash64("item"), F.lit(-(-total // pairs))) == block).select("item", "terms").toArrow()
        flat = pc.list_flatten(few.column("terms").combine_chunks()).dictionary_encode()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(few.column("terms").combine_chunks()).to_numpy())])
        codes, numbers = flat.indices.to_numpy(), few.column("item").to_pylist()
        terms = flat.dictionary.cast(pa.large_string())
        found = _frequencies(index, terms)
        weights = [math.floor(1000 * math.log((2 * facts[0] + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(terms))]
        places = [codes[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]
        early = F.pmod(F.xxhash64("shard"), F.lit(first)) == 0
        sent = spark.sparkContext.broadcast((terms, weights, [(i, p, 1) for i, p in zip(numbers, places, strict=True)]))
        begun = kept(_searched(index.where(early), sent, facts, k), "begun")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        floors = {r.item: r.score for r in begun.withColumn("r", rank).where(F.col("r") == k).select("item", "score").collect()}  # a row for each item of the block
        sent = spark.sparkContext.broadcast((terms, weights, [(i, p, floors.get(i, 1)) for i, p in zip(numbers, places, strict=True)]))
        both = begun.unionByName(_searched(index.where(~early), sent, facts, k))
        parts.append(kept(both.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k), "ranked"))
        forget(begun)
    empty = spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    ranked = empty
    for part in parts:
        ranked = ranked.unionByName(part)
    named = ranked.join(asked.select("item", id_column), "item")
    out = kept(named.select(id_column, "rank", F.when(F.col("doc_id") < NULL_ID, F.col("doc_id")).alias("doc_id"), "score"), "found")
    forget(asked, *parts)
    return out


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """Every row of benchmark against every row of documents. Nulls, repeats, ties: see search and build_index."""
    index = build_index(table(spark, sf_dir, "documents"))
    out = search(index, table(spark, sf_dir, "benchmark"))
    forget(index)
    return out


OP13_SQL = rf"""
WITH words AS (SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
tf AS MATERIALIZED (SELECT rid, doc_id, term, count(*) AS tf FROM words GROUP BY rid, doc_id, term),
size AS MATERIALIZED (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY rid),
facts AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
asked AS (SELECT DISTINCT qid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS qid, item_id, text FROM benchmark)),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term), facts),
lengths AS (SELECT rid, 50 + (50 * n * n_docs) // n_terms AS m FROM size, facts),
scores AS (SELECT qid, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (rid) GROUP BY qid, item_id, rid, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM scores WHERE score > 0) WHERE rank <= {TOP}
"""
