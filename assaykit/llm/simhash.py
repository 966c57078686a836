"""SimHash near-duplicates with candidates from pigeonring filtering.

A fingerprint's 64 bits are a ring of 16 segments of 4 bits. Two fingerprints that differ in at most
3 bits have, for some start on the ring, a chain whose first l segments differ in at most
3 l / 16 bits for every l: none in 5 segments, 1 in 10, 2 in 15. So they agree on the 20 bits of the
first five segments and, as the next five differ in one bit at most, on one half of those. These
30 bits with the start and the half are a key; a fingerprint has 32 keys. Of the fingerprints that
share a key, those whose chain stays within its budgets come to the full Hamming check. Keys with
more than LIMIT fingerprints are split by further segments, as lossless as the first ones: the other
half has one differing bit at most, so one of its two halves agrees; the chain's next five segments have
two, so one third of them agrees; of all bits not yet in the key three may differ, so one quarter of these
agrees, again and again. Equal fingerprints are one class from the start, and within a key only a
spanning forest of the links is passed on, so copies are never expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import bound_batches, forget, kept, table, text_slices
from assaykit.llm.components import components
from assaykit.shared import fresh

SEED, WIDTH, BITS, SEGMENT, MOST = 42, 3, 64, 4, 3
STARTS = BITS // SEGMENT
#: (bits of a chain, bits that may differ in them), at the lengths where the budget ends.
CHAIN = tuple((SEGMENT * max(n for n in range(1, STARTS + 1) if n * MOST // STARTS == d), d) for d in range(MOST))
#: Fingerprints of one key that are compared all with all; more are searched breadth first; of more than LIMIT the key is split.
SMALL, LIMIT = 8, 8192
#: Most keys of repeated rows that are broadcast (32 bytes each).
FEW = 200_000
_BIT_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """SimHash of a text's 3-word shingles; 0 without words. Null counts as empty."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z and the six separators
    if not words:
        return 0
    if len(words) < WIDTH:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(WIDTH)), strict=False))
    n = max(1, len(words) - WIDTH + 1)
    hashes = np.fromiter((xxh64_intdigest(x, SEED) for x in shingles), "<u8", n)
    places = hashes.view(np.uint8).reshape(n, 8) + 256 * np.arange(8, dtype=np.int64)
    ones = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BIT_TABLE
    return int.from_bytes(np.packbits(2 * ones.ravel() > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, text_hash (to tell rows of one id apart) and signed fingerprint of each row."""
    bound_batches(docs.sparkSession)
    schema = f"{id_column} {docs.schema[id_column].dataType.simpleString()}, text_hash long, fp long"

    def run(batches):
        for batch in batches:
            for lo, hi in text_slices(batch, 2):
                part = batch.slice(lo, hi - lo)
                fps = np.array([fingerprint(x) for x in part.column(2).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps.view(np.int64))], names=[id_column, "text_hash", "fp"])

    return docs.select(id_column, F.xxhash64(text_column).alias("text_hash"), text_column).mapInArrow(run, schema)


def _rotated(fp: Column, bits: int) -> Column:
    return fp if not bits else F.shiftrightunsigned(fp, bits).bitwiseOR(F.shiftleft(fp, BITS - bits))


def _keys(fp: Column) -> list[Column]:
    """The 32 keys: start and half above 30 bits of the chain."""
    low, half = (1 << CHAIN[0][0]) - 1, (CHAIN[1][0] - CHAIN[0][0]) // 2
    out = []
    for k in range(STARTS):
        ring = _rotated(fp, SEGMENT * k)
        head = F.shiftleft(ring.bitwiseAND(F.lit(low)), half)
        for which in range(2):
            part = F.shiftrightunsigned(ring, CHAIN[0][0] + which * half).bitwiseAND(F.lit((1 << half) - 1))
            out.append(head.bitwiseOR(part).bitwiseOR(F.lit((2 * k + which) << (CHAIN[0][0] + half))))
    return out


def _passes(x: np.ndarray) -> np.ndarray:
    """Of differences turned to their chain's start: whether budgets, then the whole, are kept."""
    ok = np.ones(len(x), bool)
    for bits, most in CHAIN[1:]:
        ok &= np.bitwise_count(x & np.uint64((1 << bits) - 1)) <= most
    ok[ok] = np.bitwise_count(x[ok]) <= MOST
    return ok


def _turned(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    turn = (SEGMENT * (key >> np.int64(31))).astype(np.uint64)
    return (x >> turn) | (x << ((np.uint64(BITS) - turn) & np.uint64(BITS - 1)))


def _part_masks(level: int, mask: int, half: int) -> list[int]:
    """Bits of the turned ring of which, beyond those of mask, one of the returned sets must agree."""
    if level == 1:  # the half that the key doesn't have: one bit of it may differ
        low = CHAIN[0][0] + (CHAIN[1][0] - CHAIN[0][0]) // 2 * (1 - half)
        free, most = [*range(low, low + (CHAIN[1][0] - CHAIN[0][0]) // 2)], CHAIN[1][1]
    elif level == 2:
        free, most = [*range(CHAIN[1][0], CHAIN[2][0])], CHAIN[2][1]
    else:
        free, most = [b for b in range(BITS) if not mask >> b & 1], MOST
    cuts = [len(free) * k // (most + 1) for k in range(most + 2)]
    return [sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _own_mask(half: int) -> int:
    """Bits of the turned ring that a key holds."""
    width = (CHAIN[1][0] - CHAIN[0][0]) // 2
    return ((1 << CHAIN[0][0]) - 1) | (((1 << width) - 1) << (CHAIN[0][0] + half * width))


def _splitter(level: int):
    """Rows (key, mask, bits, fp) again for each set of further bits: mask has them too, bits are the ring's under it."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches):
        for batch in batches:
            key, mask, _, fp = (c.to_numpy() for c in batch.columns)
            ring, half = _turned(fp.view(np.uint64), key), (key >> np.int64(30)) & 1
            for m, h in {*zip(mask.tolist(), half.tolist(), strict=True)}:
                own = (mask == m) & (half == h)
                whole = m % (1 << 64) or _own_mask(h)
                for more in _part_masks(level, whole, h):
                    now = whole | more
                    yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(np.full(own.sum(), signed(now), np.int64)), pa.array((ring[own] & np.uint64(now)).view(np.int64)), pa.array(fp[own])], names=["key", "mask", "bits", "fp"])

    return run


def links(group: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct fingerprints of equal groups (side by side) that connect all that are within MOST bits; key: its start turns the ring."""
    ring = _turned(fp.view(np.uint64), key)
    edge = np.flatnonzero(np.diff(group)) + 1
    begin = np.concatenate([[0], edge])
    size = np.diff(np.concatenate([begin, [len(group)]]))
    of = np.repeat(np.arange(len(begin)), size)
    a, b = [], []
    small = size[of] <= SMALL
    for step in range(1, SMALL):
        at = np.flatnonzero(small[: len(group) - step] & (of[step:] == of[: len(group) - step]))
        if not len(at):
            break
        at = at[_passes(ring[at] ^ ring[at + step])]
        a.append(at)
        b.append(at + step)
    for g in np.flatnonzero(size > SMALL):
        rest = np.arange(begin[g], begin[g] + size[g])
        while len(rest):  # each search takes a whole component out of the rest
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                x = todo.pop()
                near = _passes(ring[rest] ^ ring[x])
                found = rest[near]
                rest = rest[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                todo.extend(found.tolist())
    none = np.zeros(0, np.int64)
    return fp[np.concatenate(a) if a else none], fp[np.concatenate(b) if b else none]


def _linked(batches):
    """Over rows (key, mask, bits, fp) sorted by the first three: links (a, b). The last group of a batch waits for the next."""
    rest = [np.zeros(0, np.int64)] * 4

    def out(key, mask, bits, fp):
        new = np.zeros(len(key), bool)
        for c in (key, mask, bits):
            new[1:] |= c[1:] != c[:-1]
        a, b = links(np.cumsum(new), key, fp)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        rest = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns, strict=True)]
        if not len(rest[0]):
            continue
        last = np.ones(len(rest[0]), bool)
        for c in rest[:3]:
            last &= c == c[-1]
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield out(*(c[:cut] for c in rest))
            rest = [c[cut:] for c in rest]
    if len(rest[0]):
        yield out(*rest)


def candidate_links(classes: DataFrame, limit: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) between distinct fingerprints fp that connect all that are within MOST bits, and the tables that they read.

    Keys are counted first, by partial sums; those with more than `limit` fingerprints are split until
    none has, so no task gets an unbounded group.
    """
    limit = max(LIMIT if limit is None else limit, 2 * SMALL)
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group, none = ["key", "mask", "bits"], F.lit(0).cast("long")
    now = classes.select("fp", F.explode(F.array(*_keys(F.col("fp")))).alias("key")).select("key", none.alias("mask"), none.alias("bits"), "fp")
    out, read, level = None, [], 0
    while True:
        large = kept(now.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(*group).coalesce(8), "large-keys")
        read.append(large)
        some = not large.isEmpty()
        small = now.join(large, group, "left_anti") if some else now
        pairs = small.repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(_linked, "a long, b long")
        out = pairs if out is None else out.unionByName(pairs)
        if not some:
            return out, read
        level += 1
        now = kept(now.join(large, group, "left_semi").mapInArrow(_splitter(level), "key long, mask long, bits long, fp long"), "split-keys")
        read.append(now)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, text_hash, fp, component_id and component_text of each row.

    component_id: the smallest id of the rows that links of MOST differing bits or fewer reach,
    the row's own included; component_text: the smallest text_hash among rows of that id, which
    tells repeated ids apart. Null and wordless texts have fingerprint 0 and are linked like any
    other. Null ids are the smallest only of components without others. Repeated rows share
    their component. Other columns are left out. No rows give no rows.
    """
    found = kept(fingerprints(docs, id_column, text_column), "fingerprints")
    own = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.col("text_hash").alias("text"))
    classes = kept(found.groupBy("fp").agg(F.min(own).alias("first")), "classes")
    pairs, read = candidate_links(classes)
    member = components(pairs)
    forget(*read)
    first = member.join(classes, member.node == classes.fp).groupBy("label").agg(F.min("first").alias("least"))
    linked = member.join(first, "label").select(F.col("node").alias("fp"), "least")
    settled = kept(classes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("first")), "settled")
    forget(member, classes)
    told = found.join(settled, "fp").select(id_column, "text_hash", "fp", F.col("first.id").alias("component_id"), F.col("first.text").alias("component_text"))
    out = kept(told, "components")
    forget(found, settled)
    return out


def representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which each is the first of its component.

    The first is the row with the smallest id (then the smallest text hash); of equal rows one
    stays. Null ids stay only where their component has no other.
    """
    same = near_duplicates(docs, id_column, text_column)
    keep = same.where(F.col(id_column).eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("component_text")))
    keep = keep.groupBy(F.xxhash64(id_column).alias("_k"), F.col(id_column).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("_n"))
    k, text, row = (fresh(docs, x) for x in ("_key", "_text", "_row"))
    keyed = docs.withColumns({k: F.xxhash64(id_column), text: F.xxhash64(text_column)})

    def those(some: DataFrame) -> DataFrame:
        return keyed.join(some, (keyed[k] == some._k) & keyed[id_column].eqNullSafe(some._id) & (keyed[text] == some._hash), "left_semi")

    out = those(keep.where("_n = 1")).select(*docs.columns)
    again = keep.where("_n > 1")
    n = again.count()
    if n:  # only rows that repeat are numbered; the others' texts are sent once
        first = F.row_number().over(Window.partitionBy(k, id_column, text).orderBy(F.lit(0)))
        one = those(F.broadcast(again) if n <= FEW else again).withColumn(row, first).where(F.col(row) == 1)
        out = out.unionByName(one.select(*docs.columns))
    return out


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its fingerprint and component. Nulls, empty and repeated texts: see near_duplicates."""
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
