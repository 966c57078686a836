"""Katz backoff language model of two words: stored tables of counts and backoff weights, and their lookup.

P(w | h) = d(c) c(h w) / c(h) for pairs seen in training, else alpha(h) P(w), with
P(w) = d(c) c(w) / N for known words and the mass that is left for the unknown word. An unknown
history backs off with weight 1. d(c) is Katz's Good-Turing discount for counts up to LARGE; greater
counts c lose HELD of a count, so that no history is left without mass for what it never saw.
alpha(h) is what seen pairs leave, over what their words leave of the unigram mass: exact sums.

Texts are cut into blocks of some megabytes, whose words are coded and written once, as files in the
shared folder: tables and shuffles hold a block's dictionary and its file's name. Words get ids in
order of falling count, so a small table of (count, first id) tells every id's count; a block's
dictionary meets the word table once for each distinct word. In training a block adds up its own pairs
before they go, packed, to the pair table's parts: all pairs of a history to one, unless the history
is frequent, whose pairs are dealt by the second word too. So no part gets a pair more than once a
block. A part is one row of the stored table: histories, words and counts, sorted; a second table has the
alphas, by history. Applied to a block of any texts, the model is asked once for each distinct pair,
and for the alphas of histories whose pairs may be unseen; the block then scores its tokens.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.common import bound_batches, coded_words, drop, forget, kept, remainder, shared_dir, table, text_slices, trim

BLOCK_BYTES = 6 << 20
#: Counts over LARGE lose HELD; tokens of a part of the pair table, about.
LARGE, HELD, PART_TOKENS = 5, 0.05, 1_500_000
#: Words in a row of a block's dictionary; pairs that a part gathers before it adds them up.
ROW_WORDS, GATHERED = 20_000, 1_500_000
#: Bits of a word's place in its block's dictionary, under its id in one long.
CODE_BITS = 28
#: The token that ends a text; no word has a line feed.
END = "\n"


def discounts(of_counts: dict[int, int]) -> np.ndarray:
    """d(1) to d(LARGE) from the numbers of types by count.

    Katz's Good-Turing ratios; where one of them isn't between 0 and 1 (few types, or gaps), all
    are (r - D) / r with D = n1 / (n1 + 2 n2), or 1/2 without these.
    """
    n = [0, *(of_counts.get(r, 0) for r in range(1, LARGE + 2))]
    if all(n[1:]):
        a = (LARGE + 1) * n[LARGE + 1] / n[1]
        if a < 1:
            d = np.array([((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, LARGE + 1)])
            if ((d > 0) & (d < 1)).all():
                return d
    less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return np.array([(r - less) / r for r in range(1, LARGE + 1)])


class Unigrams:
    """Counts by id, and probabilities, of the words of training; ids from `known` on are unknown ones.

    known + 1 stands for the beginning of a text.
    """

    def __init__(self, of_counts: dict[int, int], texts: int):
        counts = sorted((c for c in of_counts if c > 0), reverse=True)
        self.counts = np.array([*counts, 0, texts], np.int64)
        self.first = np.cumsum([0, *(of_counts[c] for c in counts), 1])
        self.known = int(self.first[len(counts)])
        self.tokens = sum(c * of_counts[c] for c in counts)
        d = discounts(of_counts)
        c = self.counts[: len(counts)].astype(float)
        small = c <= LARGE
        mass = np.where(small, d[np.minimum(c, LARGE).astype(int) - 1] * c, c - HELD) / max(1, self.tokens)
        left = 1 - math.fsum(m * of_counts[int(k)] for m, k in zip(mass, c, strict=True))
        self.log_p = np.log10(np.array([*mass, left, 1.0]))
        self.base = np.log10((self.counts + 0.1) / (self.tokens + 0.1 * (self.known + 1)))

    def place(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, ids, side="right") - 1


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers or of doubles, each in the fewest bytes of its type, compressed."""
    import zstandard

    head, body = [len(arrays)], []
    for a in arrays:
        if a.dtype.kind != "f":
            a = a.astype(f"<u{next(k for k in (1, 2, 4, 8) if int(a.max(initial=0)) < 1 << 8 * k)}")
        head += [len(a), a.dtype.itemsize + 100 * (a.dtype.kind == "f")]
        body.append(a.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(np.array(head, "<i8").tobytes() + b"".join(body))


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in four bytes where these are enough, else in eight."""
    return a.astype(np.int32 if int(a.max(initial=0)) < 1 << 31 else np.int64)


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head, at, out = np.frombuffer(data, "<i8", 2 * n, 8).reshape(n, 2), 8 + 16 * n, []
    for length, kind in head.tolist():
        a = np.frombuffer(data, f"<f{kind - 100}" if kind > 100 else f"<u{kind}", length, at)
        at += a.nbytes
        out.append(a.copy() if kind > 100 else narrow(a))
    return out


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _by_pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Stable order by (h, w)."""
    if max(int(h.max(initial=0)), int(w.max(initial=0))) < 1 << 31:
        return np.argsort((h.astype(np.int64) << 32) | w, kind="stable")
    return np.lexsort((w, h))


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


class _Files:
    """Files of a shared folder, each written once under a name of its own: attempts never meet."""

    def __init__(self, path: str):
        self.store, self.folder = pa.fs.FileSystem.from_uri(path)
        self.store.create_dir(self.folder, recursive=True)

    def put(self, data: bytes) -> str:
        name = uuid.uuid4().hex
        with self.store.open_output_stream(f"{self.folder}/{name}", compression=None) as f:
            f.write(data)
        return name

    def get(self, name: str) -> bytes:
        with self.store.open_input_file(f"{self.folder}/{name}") as f:
            return f.read()


def _text_coder(path: str):
    """Blocks of batches (id, trained, text): rows of their dictionary, the first with the name of the file of the texts' codes, ends and marks."""

    def run(batches):
        files, task, k = _Files(path), TaskContext.get(), 0
        for batch in batches:
            for lo, hi in text_slices(batch, 2, BLOCK_BYTES):
                part = batch.slice(lo, hi - lo)
                codes, ends, words = coded_words(part.column(2), lower=True)
                codes, ends = np.insert(codes, ends[1:], len(words)), ends + np.arange(len(ends))
                names = pa.concat_arrays([words.cast(pa.string()), pa.array([END])])
                trained = part.column(1).to_numpy(zero_copy_only=False)
                n = np.bincount(codes[np.repeat(trained, np.diff(ends))], minlength=len(names)).astype(np.int64)
                block, file = ((task.partitionId() if task else 0) << 32) + k, files.put(pack(codes, ends, trained.astype(np.int64)))
                for at in range(0, len(names), ROW_WORDS):
                    some, first = n[at : at + ROW_WORDS], at == 0
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block]),
                            pa.array([at]),
                            pa.ListArray.from_arrays([0, len(some)], names.slice(at, len(some))),
                            pa.ListArray.from_arrays([0, len(some)], pa.array(some)),
                            pa.array([file if first else None], pa.string()),
                            pa.array([part.column(0).to_pylist() if first else None], pa.list_(part.schema.types[0])),
                        ],
                        names=["block", "at", "words", "n", "file", "ids"],
                    )
                del codes, ends, words, names, n
                trim()
                k += 1

    return run


def _numbered(batches):
    """Rows in their partition's order, numbered."""
    k, task = 0, TaskContext.get()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), task.partitionId() if task else 0)), pa.array(np.arange(k, k + len(batch)))], names=[*batch.schema.names, "part", "k"])
        k += len(batch)


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (id, trained, text) as a written table of coded blocks, whose files are in its folder _files."""
    kind = rows.schema["id"].dataType.simpleString()
    path = shared_dir(rows.sparkSession, "katz-blocks")
    out = kept(rows.mapInArrow(_text_coder(path), f"block long, at long, words array<string>, n array<long>, file string, ids array<{kind}>"), "katz-texts")
    out._files = path
    return out


def _entries(blocks: DataFrame) -> DataFrame:
    """(block, code, word, n) of the blocks' dictionaries."""
    each = blocks.select("block", "at", F.posexplode(F.arrays_zip("words", "n")).alias("pos", "x"))
    return each.select("block", (F.col("at") + F.col("pos")).alias("code"), F.col("x.words").alias("word"), F.col("x.n").alias("n"))


def _coded(blocks: DataFrame, words: DataFrame, known: int) -> DataFrame:
    """(block, file, ids): the blocks, which go, with the model's ids for words; written. A file has ids by code, codes, ends, marks."""
    ids_type = blocks.schema["ids"].dataType.simpleString()
    own = _entries(blocks).select("block", "code", "word").join(words.select("word", "gid"), "word", "left")
    own = kept(own.select("block", (F.coalesce("gid", F.lit(known)) * (1 << CODE_BITS) + F.col("code")).alias("entry")), "katz-ids")
    texts = blocks.where("file IS NOT NULL").select(F.col("block").alias("of"), "file", "ids")
    source, path = blocks._files, shared_dir(blocks.sparkSession, "katz-coded-blocks")

    def code(left, right):
        entry = left["entry"].to_numpy()
        gids = np.empty(left.num_rows, np.int64)
        gids[entry & ((1 << CODE_BITS) - 1)] = entry >> CODE_BITS
        codes, ends, trained = unpack(_Files(source).get(right["file"][0].as_py()))
        trim()
        return pa.table({"block": right["of"], "file": pa.array([_Files(path).put(pack(gids, codes, ends, trained))]), "ids": right["ids"]})

    n = _tasks(texts)
    out = kept(own.repartition(n, "block").groupBy("block").cogroup(texts.repartition(n, "of").groupBy("of")).applyInArrow(code, f"block long, file string, ids {ids_type}"), "katz-coded")
    out._files = path
    forget(own, blocks)
    drop(blocks.sparkSession, source)
    return out


def _tasks(blocks: DataFrame) -> int:
    """Tasks for work on some blocks: their rows are small, but each is megabytes of work."""
    return max(1, min(blocks.count(), 4 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _spread(coded: DataFrame) -> DataFrame:
    """(block, file) of coded blocks, dealt evenly."""
    return coded.select("block", "file").repartition(_tasks(coded))


def _forget_coded(coded: DataFrame) -> None:
    drop(coded.sparkSession, coded._files)
    forget(coded)


@dataclass
class Model:
    """words: (word, gid, c); pairs, histories: (part, payload), packed arrays of histories with words and counts, and with log10 alphas; d: discounts of pairs."""

    words: DataFrame
    pairs: DataFrame
    histories: DataFrame
    of_counts: dict[int, int]
    texts: int
    parts: int
    frequent: int
    d: np.ndarray
    tables: tuple[DataFrame, ...] = ()

    @property
    def unigrams(self) -> Unigrams:
        return Unigrams(self.of_counts, self.texts)

    def forget(self) -> None:
        """Delete the tables of a model that was learned and not read; a written copy stays."""
        forget(*self.tables)

    def write(self, path: str) -> None:
        """The model's tables under path, which must not be there."""
        for name in ("words", "pairs", "histories"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        facts = [(list(self.of_counts), list(self.of_counts.values()), self.texts, self.parts, self.frequent, self.d.tolist())]
        self.words.sparkSession.createDataFrame(facts, "counts array<long>, types array<long>, texts long, parts long, frequent long, d array<double>").write.parquet(f"{path}/facts")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Model:
        f = spark.read.parquet(f"{path}/facts").first()
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("words", "pairs", "histories")), dict(zip(f.counts, f.types, strict=True)), f.texts, f.parts, f.frequent, np.array(f.d))


def _tokens(u: Unigrams, payload: bytes):
    """Of a coded block: each token's id, its history's id, its text, and the texts' ends and marks."""
    gids, codes, ends, trained = unpack(payload)
    token = gids[codes]
    history = np.empty_like(token)
    history[1:] = token[:-1]
    history[ends[:-1]] = u.known + 1
    return token, history, np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends)), ends, trained.astype(bool)


def _part(u: Unigrams, parts: int, frequent: int, h: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The part of pairs, or of histories' alphas where w is None."""
    second = np.zeros_like(h) if w is None else np.where(u.counts[u.place(h)] > frequent, w, 0)
    return (_mix(h, second) % np.uint64(parts)).astype(np.int64)


def _by_part(part: np.ndarray, parts: int):
    """(part, places of what belongs to it, in order)."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[cuts[p] : cuts[p + 1]]) for p in np.flatnonzero(np.diff(cuts)).tolist()]


def _distinct(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by pair, where each distinct pair begins in it, and the pair of each place in it."""
    order = _by_pair(h, w)
    begin = _begins(h[order], w[order])
    return order, begin, np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h))))


def _steps(h: np.ndarray) -> np.ndarray:
    return np.diff(h, prepend=0)


def _added(h: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = _by_pair(h, w)
    h, w, n = h[order], w[order], n[order]
    begin = _begins(h, w)
    return h[begin], w[begin], np.add.reduceat(n, begin) if len(begin) else n


def _key(u: Unigrams, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs as sortable scalars."""
    if u.known < (1 << 31) - 2:
        return (h.astype(np.int64) << 32) | w
    return np.column_stack([h, w]).astype(">u8").view("S16").ravel()


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values of asked keys among sorted keys, 0 for others."""
    if not len(keys):
        return np.zeros(len(asked), values.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0)


def _log_alpha(taken: np.ndarray, seen: np.ndarray, times: np.ndarray) -> np.ndarray:
    return np.log10((1 - taken / times) / (1 - seen))


def _learn(blocks: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the blocks' trained texts, and the blocks, which go, coded by it."""
    spark = blocks.sparkSession
    shuffle_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = _entries(blocks).groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")
    ordered = counted.repartitionByRange(shuffle_parts, F.desc("c"), "word").sortWithinPartitions(F.desc("c"), "word")
    numbered = kept(ordered.mapInArrow(_numbered, "word string, c long, part long, k long"), "katz-words")
    of_counts = {r.c: r.n for r in numbered.groupBy("c").agg(F.count("*").alias("n")).collect()}  # at most sqrt(2 N) counts
    texts = (numbered.where(F.col("word") == END).agg(F.sum("c")).first()[0]) or 0
    unigrams = Unigrams(of_counts, texts)
    offset, offsets = 0, []
    for r in sorted(numbered.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        offsets.append((r.part, offset))
        offset += r.n
    starts = F.broadcast(spark.createDataFrame(offsets or [(-1, 0)], "part long, start long"))
    words = numbered.join(starts, "part").select("word", (F.col("start") + F.col("k")).alias("gid"), "c")
    coded = _coded(blocks, words, unigrams.known)
    parts, frequent = max(shuffle_parts, math.ceil(unigrams.tokens / PART_TOKENS)), PART_TOKENS // 64
    shared = spark.sparkContext.broadcast(unigrams)

    blocks_at = coded._files

    def block_pairs(batches):
        u, files = shared.value, _Files(blocks_at)
        for batch in batches:
            for name in batch.column(1).to_pylist():
                token, history, text, _, trained = _tokens(u, files.get(name))
                own = trained[text]
                h, w = history[own], token[own]
                order, begin, _ = _distinct(h, w)
                h, w, n = h[order][begin], w[order][begin], np.diff(np.append(begin, len(order)))
                for p, at in _by_part(_part(u, parts, frequent, h, w), parts):
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([pack(_steps(h[at]), w[at], n[at])], pa.binary())], names=["part", "payload"])
                del token, history, text, own, h, w, n, order, begin
                trim()

    def add_up(batches):
        here, rest, size = None, [], 0

        def merged():
            return _added(*(np.concatenate([x[k] for x in rest]) for k in range(3)))

        for batch in batches:
            for p, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if here not in (None, p):
                    raise ValueError("two parts in one partition")
                here, (h, w, n) = p, unpack(payload.as_py())
                rest.append((np.cumsum(h, dtype=np.int64), w, n))
                size += len(w)
                if size > GATHERED:
                    rest = [merged()]
                    size = 0
                    trim()
        if here is not None:
            h, w, n = merged()
            sizes, many = np.unique(n[n <= LARGE + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([here]), pa.array([pack(_steps(h), w, n)], pa.binary()), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([many.tolist()], pa.list_(pa.int64()))], names=["part", "payload", "sizes", "types"])

    sent = _spread(coded).mapInArrow(block_pairs, "part long, payload binary").repartitionById(parts, F.col("part").cast("int"))
    pairs = kept(sent.mapInArrow(add_up, "part long, payload binary, sizes array<long>, types array<long>"), "katz-pairs")
    sizes = pairs.select(F.explode(F.arrays_zip("sizes", "types")).alias("x")).groupBy("x.sizes").agg(F.sum("x.types").alias("n"))
    d = discounts({r.sizes: r.n for r in sizes.collect()})  # six rows

    def part_histories(batches):
        """A part's alphas; of frequent histories, which other parts have too, what it adds."""
        u = shared.value
        for batch in batches:
            for p, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, w, n = unpack(payload.as_py())
                h = np.cumsum(h, dtype=np.int64)
                begin = _begins(h)
                if not len(begin):
                    continue
                taken = np.add.reduceat(np.where(n > LARGE, n - HELD, d[np.minimum(n, LARGE) - 1] * n), begin)
                seen = np.add.reduceat(10.0 ** u.log_p[u.place(w)], begin)
                h = h[begin]
                times = u.counts[u.place(h)]
                whole = times <= frequent
                found = pack(_steps(h[whole]), _log_alpha(taken[whole], seen[whole], times[whole]))
                m = int((~whole).sum())
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([found], pa.binary()), *(pa.array([x[~whole].tolist()], t) for x, t in ((h, pa.list_(pa.int64())), (taken, pa.list_(pa.float64())), (seen, pa.list_(pa.float64()))))], names=["part", "payload", "h", "taken", "seen"])

    def frequent_histories(batches):
        u = shared.value
        for batch in batches:
            h, taken, seen = (batch.column(k).to_numpy() for k in range(3))
            order = np.argsort(h)
            h, alpha = h[order], _log_alpha(taken[order], seen[order], u.counts[u.place(h[order])])
            for p, at in _by_part(_part(u, parts, frequent, h), parts):
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([pack(_steps(h[at]), alpha[at])], pa.binary())], names=["part", "payload"])

    sums = kept(pairs.select("part", "payload").mapInArrow(part_histories, "part long, payload binary, h array<long>, taken array<double>, seen array<double>"), "katz-sums")
    shares = sums.select(F.explode(F.arrays_zip("h", "taken", "seen")).alias("x")).groupBy("x.h").agg(F.sum("x.taken").alias("taken"), F.sum("x.seen").alias("seen"))
    histories = kept(sums.select("part", "payload").unionByName(shares.mapInArrow(frequent_histories, "part long, payload binary")), "katz-histories")
    forget(sums)
    return Model(words, pairs.select("part", "payload"), histories, of_counts, texts, parts, frequent, d, (numbered, pairs, histories)), coded


_PAIRS, _HISTORIES, _ASKED = range(3)


def _apply(model: Model, coded: DataFrame, once: bool = False) -> DataFrame:
    """id, trained, n_tokens, n_known, base and score of each text of coded blocks, which go, with the model if it is used once; written."""
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast(model.unigrams)
    parts, frequent, d = model.parts, model.frequent, model.d

    def questions(u: Unigrams, payload: bytes):
        token, history, text, ends, trained = _tokens(u, payload)
        asked = u.counts[u.place(history)] > 0  # an unknown history needs no table
        h, w = history[asked], token[asked]
        order, begin, pair = _distinct(h, w)
        some = np.unique(h[~trained[text[asked]]])  # pairs of the model's own texts are all seen
        h, w = h[order][begin], w[order][begin]
        return (token, text, ends, trained, asked, order, pair), (h, w, _by_part(_part(u, parts, frequent, h, w), parts)), (some, dict(_by_part(_part(u, parts, frequent, some), parts)))

    blocks_at = coded._files

    def ask(batches):
        u, files = shared.value, _Files(blocks_at)
        for batch in batches:
            for block, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, (h, w, pairs), (some, alphas) = questions(u, files.get(name))
                none = np.zeros(0, np.int64)
                pairs = dict(pairs)
                for p in sorted(pairs.keys() | alphas.keys()):
                    at, of = pairs.get(p, none), alphas.get(p, none)
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([_ASKED]), pa.array([block]), pa.array([pack(_steps(h[at]), w[at], _steps(some[of]))], pa.binary())], names=["part", "kind", "block", "payload"])
                del h, w, pairs, some, alphas
                trim()

    def answer(batches):
        u = shared.value
        here, keys, n, h, alpha, ready = None, [], [], [], [], False
        for batch in batches:
            for p, kind, block, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if here not in (None, p):
                    raise ValueError("two parts in one partition")
                here, got = p, unpack(payload.as_py())
                first = np.cumsum(got[0], dtype=np.int64)
                if kind == _PAIRS:
                    keys.append(_key(u, first, got[1]))
                    n.append(got[2])
                    continue
                if kind == _HISTORIES:
                    h.append(first)
                    alpha.append(got[1])
                    continue
                if not ready:
                    keys, n = np.concatenate(keys or [np.zeros(0, np.int64)]), np.concatenate(n or [np.zeros(0, np.int64)])
                    h, alpha = np.concatenate(h or [np.zeros(0, np.int64)]), np.concatenate(alpha or [np.zeros(0)])
                    order = np.argsort(h)
                    h, alpha, ready = h[order], alpha[order], True
                times, weights = _found(keys, n, _key(u, first, got[1])), _found(h, alpha, np.cumsum(got[2], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([p]), pa.array([pack(times, weights.astype(float))], pa.binary())], names=["block", "part", "payload"])

    def score(left, right):
        u = shared.value
        (token, text, ends, trained, asked, order, pair), (h, _, pairs), (some, alphas) = questions(u, _Files(blocks_at).get(left["file"][0].as_py()))
        told = {p: unpack(x) for p, x in zip(right["part"].to_pylist(), right["payload"].to_pylist(), strict=True)} if right.num_rows else {}
        times, alpha = np.zeros(len(h), np.int64), np.zeros(len(some))
        for p, at in pairs:
            times[at] = told[p][0]
        for p, at in alphas.items():
            alpha[at] = told[p][1]
        log_w = u.log_p[u.place(token)]
        known_history = u.counts[u.place(h)]
        with np.errstate(divide="ignore"):
            seen = np.log10(np.where(times > LARGE, times - HELD, d[np.clip(times, 1, LARGE) - 1] * times) / known_history)
        worth = log_w.copy()  # an unknown history backs off with weight 1
        at = np.flatnonzero(asked)[order]
        weight = alpha[np.minimum(np.searchsorted(some, h), max(0, len(some) - 1))] if len(some) else np.zeros(len(h))
        worth[at] = np.where(times[pair] > 0, seen[pair], weight[pair] + log_w[at])
        n = len(ends) - 1
        del asked, order, pair, seen, known_history, times, told
        trim()
        return pa.table(
            {
                "id": pa.array(left["ids"][0].as_py(), left.schema.field("ids").type.value_type),
                "trained": pa.array(trained),
                "n_tokens": pa.array(np.diff(ends).astype(np.int64)),
                "n_known": pa.array(np.bincount(text, token < u.known, n).astype(np.int64)),
                "base": pa.array(np.bincount(text, u.base[u.place(token)], n)),
                "score": pa.array(np.bincount(text, worth, n)),
            }
        )

    none = F.lit(None).cast("long").alias("block")
    stored = [t.select("part", F.lit(kind).cast("long").alias("kind"), none, "payload") for kind, t in ((_PAIRS, model.pairs), (_HISTORIES, model.histories))]
    asked = _spread(coded).mapInArrow(ask, "part long, kind long, block long, payload binary")
    both = stored[0].unionByName(stored[1]).unionByName(asked).repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("kind")
    answers = kept(both.mapInArrow(answer, "block long, part long, payload binary"), "katz-answers")
    if once:
        model.forget()
    kind = coded.schema["ids"].dataType.elementType.simpleString()
    n = _tasks(coded)
    scored = coded.repartition(n, "block").groupBy("block").cogroup(answers.repartition(n, "block").groupBy("block")).applyInArrow(score, f"id {kind}, trained boolean, n_tokens long, n_known long, base double, score double")
    out = kept(scored, "katz-scores")
    forget(answers)
    _forget_coded(coded)
    return out


def _rows(docs: DataFrame, trained, id_column: str, text_column: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_column).alias("id"), trained.alias("trained"), F.col(text_column).alias("text"))


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """The model of all texts of docs: null or empty ones have the end alone, repeated rows count each, no rows give a model without words."""
    blocks = _blocks(_rows(docs, F.lit(True), id_column, text_column))
    model, coded = _learn(blocks)
    _forget_coded(coded)
    return model


def score_other(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Texts that the model wasn't learned from, or as if: id, n_tokens, n_known, base_score and score as in score_texts."""
    blocks = _blocks(_rows(docs, F.lit(False), id_column, text_column))
    coded = _coded(blocks, model.words, model.unigrams.known)
    return _apply(model, coded).select(F.col("id").alias(id_column), "n_tokens", "n_known", F.col("base").alias("base_score"), "score")


def score_texts(docs: DataFrame, folds: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Train on rows whose crc32(id as text) mod folds isn't 0; score every row.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score and score, a log10 probability.
    Tokens are words with A-Z in lower case, then one end. A null or empty text has the end alone. A
    null id counts as the text '' for the fold. Repeated rows are counted and scored each. Without
    training rows every score is 0. docs is read once; a very long text is a block of its own. Other
    columns are left out. No rows give no rows.
    """
    blocks = _blocks(_rows(docs, remainder(id_column, folds) != 0, id_column, text_column))
    model, coded = _learn(blocks)
    return _apply(model, coded, once=True).select(
        F.col("id").alias(id_column),
        (~F.col("trained")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.unigrams.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )


def op4_katz(spark, sf_dir: str) -> DataFrame:
    """All rows of documents, learned from folds 1 to 9 of 10. Nulls, empty texts and repeats: see score_texts."""
    return score_texts(table(spark, sf_dir, "documents"))
