"""Factorisation machines over hashed words, and over bins of text statistics and metadata where asked for.

A document's features are the hashes of its distinct words (32 bits, so that strangers hardly ever
share one) and one bin for each statistic and each column of metadata. All hashes that SUPPORT documents
hold take part in training, which fits linear weights and `rank` factors for each feature by AdaGrad on the
logistic loss. Terms that don't go with the label alone are held back, not left out: their penalties grow as
the root of their chi-squared statistic falls under ROOT (an adaptive lasso on weights, an adaptive ridge on
factors), so what they tell in pairs can still be learned, as in an exclusive-or. A score sums pairwise
interactions in linear time: half of the squared sum of factors less their squares' sum.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import bound_batches, coded_words, remainder, text_slices, trim
from assaykit.llm.stats import NAMES, statistics
from assaykit.shared import fresh

#: Rows that a model is fitted on at most, chosen by a hash of their ids.
SAMPLE = 12_000
#: Least documents that hold a term; the root of its chi-squared statistic from which a term is hardly held back.
SUPPORT, ROOT = 5, 4.5
#: Penalties of weights and of factors at ROOT; the power by which they grow under it, and the most that they do.
LASSO, RIDGE, POWER, MOST = 1e-4, 3e-3, 4, 30.0
#: Of the penalties, the share that bins of statistics and metadata bear.
BINS_HELD = 0.1
BINS, EDGE_MARKS = 8, "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), 0xAB, 0xBB, 0xA1, 0xBF]))


@dataclass
class Machine:
    """Weights: bias, linear part, factors. terms: sorted hashes, the first features; edges: bins of statistics, then of metadata (names of columns), the others."""

    terms: np.ndarray
    edges: np.ndarray | None
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    metadata: tuple[str, ...] = ()

    def scores(self, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Probability of label 1 for n documents; feature ids[i] is one of document owner[i]."""
        total = self.bias + np.bincount(owner, self.linear[ids], n)
        for f in self.factors.T:
            x = f[ids]
            total += 0.5 * (np.bincount(owner, x, n) ** 2 - np.bincount(owner, x * x, n))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, hash of a lower-case word without marks at its ends) of some texts."""
    codes, ends, distinct = coded_words(texts, lower=True)
    bare = pc.utf8_trim(distinct, characters=EDGE_MARKS).to_pylist()
    hashes = np.array([zlib.crc32(x.encode()) for x in bare], np.int64)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    both = np.unique((owner << 32) | (hashes[codes] if len(hashes) else codes))
    return both >> 32, both & 0xFFFFFFFF


def _features(machine_terms: np.ndarray, edges: np.ndarray | None, owner: np.ndarray, hashes: np.ndarray, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    place = np.searchsorted(machine_terms, hashes)
    place[place == len(machine_terms)] = 0
    hit = machine_terms[place] == hashes if len(machine_terms) else np.zeros(len(hashes), bool)
    ids, own = place[hit], owner[hit]
    if edges is not None:
        bins = np.column_stack([np.searchsorted(e, x, side="right") for e, x in zip(edges, table.T, strict=True)]) if len(table) else np.zeros((0, len(edges)), np.int64)
        bins += len(machine_terms) + BINS * np.arange(len(edges))
        ids = np.concatenate([ids, bins.ravel()])
        own = np.concatenate([own, np.repeat(np.arange(len(bins)), len(edges))])
    return ids.astype(np.int64), own


def _by_row(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of values that lie row by row, sizes[r] of them for row r."""
    out = np.zeros((len(sizes), *values.shape[1:]))
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


def fit(labels: np.ndarray, owner: np.ndarray, hashes: np.ndarray, table: np.ndarray | None, rank: int = 8, steps: int = 1200, batch: int = 256, rate: float = 0.1, seed: int = 7, support: int = SUPPORT, root: float = ROOT) -> Machine:
    """Fit a machine on all terms of `support` documents, those under `root` held back; with one label alone, or no rows, it scores that label's smoothed share."""
    n, y = len(labels), labels.astype(float)
    distinct, code = np.unique(hashes, return_inverse=True)
    with_term = np.bincount(code, minlength=len(distinct)).astype(float)
    with_both = np.bincount(code, y[owner], len(distinct))
    ones = y.sum()
    spread = with_term * (n - with_term) * ones * (n - ones)
    reached = np.sqrt(n / np.maximum(spread, 1)) * np.abs(with_both * (n - ones) - (with_term - with_both) * ones)
    some = with_term >= support
    terms = distinct[some].astype(np.int64)
    del distinct, code
    edges = None if table is None else np.quantile(table, np.arange(1, BINS) / BINS, axis=0).T if n else np.zeros((table.shape[1], BINS - 1))
    size = len(terms) + (0 if edges is None else BINS * len(edges))
    held = np.full(size, BINS_HELD)
    held[: len(terms)] = np.minimum((root / np.maximum(reached[some], 1e-3)) ** POWER, MOST)
    rng = np.random.default_rng(seed)
    prior = (ones + 0.5) / (n + 1)
    machine = Machine(terms, edges, float(np.log(prior / (1 - prior))), np.zeros(size), rng.normal(0, 0.01, (size, rank)))
    if not 0 < ones < n or not size:
        machine.factors[:] = 0
        return machine
    ids, own = _features(terms, edges, owner, hashes, table)
    order = np.argsort(own, kind="stable")
    ids, start = ids[order].astype(np.int32), np.searchsorted(own[order], np.arange(n + 1))
    del own, order
    trim()
    sq_bias, sq_linear, sq_factors = 1e-8, np.full(size, 1e-8), np.full((size, rank), 1e-8)
    parts = max(1, n // batch)
    for _ in range(-(-steps // parts)):
        for rows in np.array_split(rng.permutation(n), parts):
            size_of = start[rows + 1] - start[rows]
            own_b = np.repeat(np.arange(len(rows)), size_of)
            ids_b = ids[np.repeat(start[rows] - np.concatenate([[0], np.cumsum(size_of)[:-1]]), size_of) + np.arange(size_of.sum())]
            own_factors = machine.factors[ids_b]
            sums = _by_row(own_factors, size_of)
            total = machine.bias + _by_row(machine.linear[ids_b], size_of) + 0.5 * ((sums**2).sum(1) - _by_row((own_factors**2).sum(1), size_of))
            wrong = (1 / (1 + np.exp(-np.clip(total, -40, 40))) - y[rows]) / len(rows)
            used = np.flatnonzero(np.bincount(ids_b, minlength=size))
            weight = np.bincount(ids_b, wrong[own_b], size)[used]
            grads = np.column_stack([np.bincount(ids_b, x[own_b], size)[used] for x in (wrong[:, None] * sums).T])
            grads += (RIDGE * held[used] - weight)[:, None] * machine.factors[used]
            sq_bias += wrong.sum() ** 2
            sq_linear[used] += weight**2
            sq_factors[used] += grads**2
            machine.bias -= rate * wrong.sum() / np.sqrt(sq_bias)
            step = rate / np.sqrt(sq_linear[used])
            now = machine.linear[used] - step * weight
            machine.linear[used] = np.sign(now) * np.maximum(np.abs(now) - step * LASSO * held[used], 0)
            machine.factors[used] -= 0.2 * rate * grads / np.sqrt(sq_factors[used])
    return machine


def _edge(sample: int, n: int) -> int:
    """The largest of 64-bit hashes that `sample` of n rows reach, about, however many rows there are."""
    return min((1 << 63) - 1, (1 << 64) * sample // max(1, n) - (1 << 63))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int = 5, sample: int = SAMPLE, metadata: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, y, text, m0, m1, ... for metadata) of at most about `sample` labelled documents outside fold 0.

    Labels other than 0 and 1 and null ids are left out, as are ids with both labels. Of repeated
    documents the smallest text counts. The rows are chosen by a hash of their ids.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != 0))
    own = own.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_other")).where("y = _other").select("doc_id", "y")
    n = own.count()
    chosen = own.where(F.xxhash64("doc_id") <= F.lit(_edge(sample, n)).cast("long"))
    names = [f"m{k}" for k in range(len(metadata))]
    rows = docs.select("doc_id", F.struct("text", *(c.alias(n) for c, n in zip(_metadata(docs, metadata), names, strict=True))).alias("x"))
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("doc_id", "y", "x.text", *(f"x.{n}" for n in names))


def _metadata(docs: DataFrame, names: tuple[str, ...]) -> list:
    """Columns of metadata as doubles, -1 for nulls and for columns that docs doesn't have."""
    there = {c.lower() for c in docs.columns}
    return [F.coalesce(F.col(c).cast("double") if c.lower() in there else F.lit(None).cast("double"), F.lit(-1.0)) for c in names]


def _table(batch: pa.RecordBatch, text: int, metadata: range) -> np.ndarray:
    """Statistics and metadata of a batch's rows."""
    return np.column_stack([statistics(batch.column(text)), *(batch.column(k).to_numpy() for k in metadata)])


def learn(docs: DataFrame, labels: DataFrame, label: str, with_statistics: bool, sample: int = SAMPLE, metadata: tuple[str, ...] = (), support: int = SUPPORT, root: float = ROOT) -> Machine:
    """Fit a machine on a bounded sample of labelled documents, on the driver.

    support, root: see fit. metadata: numeric columns of docs, used beside the statistics. Null texts count as empty, nulls
    and absent columns of metadata as -1. Which rows are taken, and what of repeated ones: labelled_sample.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, hi in text_slices(batch, 1):
                part = batch.slice(lo, hi - lo)
                owner, hashes = term_hashes(part.column(1))
                stats = _table(part, 1, range(3, 3 + len(metadata))) if with_statistics else np.zeros((len(part), 0))
                edges = np.searchsorted(owner, np.arange(len(part) + 1))
                terms = [hashes[a:b].astype("<u4").tobytes() for a, b in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(terms, pa.binary()), pa.array([x.astype("<f8").tobytes() for x in stats], pa.binary())], names=["doc_id", "y", "terms", "stats"])

    chosen = labelled_sample(docs, labels, label, sample=sample, metadata=metadata)
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    rows = chosen.select("doc_id", "text", "y", *(f"m{k}" for k in range(len(metadata)))).mapInArrow(run, f"doc_id {kinds['doc_id']}, y {kinds['y']}, terms binary, stats binary").toArrow().sort_by("doc_id")
    y = rows.column("y").to_numpy().astype(np.int64)
    terms = rows.column("terms").to_pylist()
    hashes = np.frombuffer(b"".join(terms), "<u4")
    owner = np.repeat(np.arange(len(terms), dtype=np.int32), [len(x) // 4 for x in terms])
    stats = np.frombuffer(b"".join(rows.column("stats").to_pylist()), "<f8").reshape(len(y), len(NAMES) + len(metadata)) if with_statistics else None
    machine = fit(y, owner, hashes, stats, support=support, root=root)
    machine.metadata = metadata
    return machine


def score(docs: DataFrame, machine: Machine, threshold: float) -> DataFrame:
    """(doc_id, score, predicted) of each row.

    A null text scores as an empty one. Equal texts have equal scores. Other columns are left out.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(machine)

    def run(batches):
        m = model.value
        for batch in batches:
            for lo, hi in text_slices(batch, 1):
                part = batch.slice(lo, hi - lo)
                owner, hashes = term_hashes(part.column(1))
                stats = _table(part, 1, range(2, 2 + len(m.metadata))) if m.edges is not None else None
                ids, own = _features(m.terms, m.edges, owner, hashes, stats)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.scores(ids, own, len(part)))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = [c.alias(f"m{k}") for k, c in enumerate(_metadata(docs, machine.metadata))]
    got = docs.select("doc_id", "text", *columns).mapInArrow(run, f"doc_id {kind}, score double")
    return got.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_rows(docs: DataFrame, machine: Machine) -> tuple[DataFrame, str]:
    """All columns of docs with the score after them, and that column's name: for filters, which need no join then.

    A null text scores as an empty one, repeated rows score each, the score's name is none of docs'
    columns, and no rows give no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(machine)
    at, name, last = docs.columns.index("text"), fresh(docs, "_score"), len(docs.columns)

    def run(batches):
        m = model.value
        for batch in batches:
            for lo, hi in text_slices(batch, at):
                part = batch.slice(lo, hi - lo)
                owner, hashes = term_hashes(part.column(at))
                stats = _table(part, at, range(last, last + len(m.metadata))) if m.edges is not None else None
                ids, own = _features(m.terms, m.edges, owner, hashes, stats)
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(m.scores(ids, own, len(part)))], names=[*part.schema.names[:last], name])

    columns = [c.alias(fresh(docs, f"_m{k}")) for k, c in enumerate(_metadata(docs, machine.metadata))]
    return docs.select("*", *columns).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name
