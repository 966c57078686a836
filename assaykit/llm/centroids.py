"""Exact k-means over whole numbers with adaptive bounds, so that most vectors are never compared again.

Each vector keeps, in order, its several nearest centroids as of the last comparison: an upper bound
of its distance to the first, lower bounds to the others, and one lower bound that holds for all
remaining centroids. When centroids move, bounds give way by as much. A vector whose upper bound
stays under all lower ones keeps its centroid; otherwise its distance is made exact, then the places
that lower bounds don't rule out are compared and put in order again, and only where the remainder's
bound doesn't hold either all centroids are. Bounds are strict, so ties are always compared.

A round is one narrow pass: it reads the vectors with their bounds and writes them again, with what
each batch moves from centroid to centroid. New centroids come from sums of these small rows alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import bound_batches, drop, kept, one_thread, shared_dir, table
from assaykit.shared import passing

#: Centroids, rounds, nearest centroids that a vector keeps apart from the remainder; length of vectors, and steps to a unit.
COUNT, ROUNDS, NEARBY, LENGTH, SCALE = 16, 3, 4, 64, 64
#: Largest component: with it, a squared distance still fits a long. Larger ones raise an error.
LARGEST = 1 << 27
#: Bounds are widened by this share whenever they are made or moved, more than rounding can take.
SLACK = 1e-12


def whole_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """(id, v) of each row whose vector has exactly `length` components, none null or non-finite; v: floor(scale * component)."""
    x = F.col(column)
    fine = (F.size(x) == length) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    cells = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), cells.alias("v"))
    over = F.exists("v", lambda c: F.abs(c.cast("double")) > LARGEST)
    whole = F.transform("v", lambda c: c.cast("int"))
    return rows.select("id", F.when(over, F.raise_error(F.lit(f"a component of over {LARGEST}: squared distances don't fit a long"))).otherwise(whole).alias("v"))


def first_centroids(rows: DataFrame, count: int = COUNT) -> np.ndarray:
    """The vectors whose ids have the smallest SHA-256 of `1:<id>`, in that order; ties by the vector, a null id as an empty one."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    got = rows.select(name.alias("h"), "v").orderBy("h", "v").limit(count).collect()
    return np.array([r.v for r in got], np.int64).reshape(len(got), len(got[0].v) if got else 0)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    reach = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * reach * reach < 1 << 53:  # all sums are whole numbers that doubles hold
        a, c = x.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        out[:, k] = ((x - c) ** 2).sum(1)
    return out


def own_squared(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - centroids[cluster]) ** 2).sum(1)


def compared(x: np.ndarray, centroids: np.ndarray, nearby: int = NEARBY) -> tuple[np.ndarray, np.ndarray]:
    """(near, bounds) after comparing every row with all centroids.

    near: the nearest centroids, nearest first, ties to the smaller number. bounds: an upper bound of
    the first one's distance, lower bounds of the others', a lower bound of all remaining ones'.
    """
    b = min(nearby, len(centroids))
    exact = squared(x, centroids)
    order = np.argsort(exact, axis=1, kind="stable")[:, : b + 1]
    far = np.sqrt(np.take_along_axis(exact, order, 1).astype(float))
    bounds = np.full((len(x), b + 1), np.inf)
    bounds[:, : far.shape[1]] = far * (1 - SLACK)
    bounds[:, 0] = far[:, 0] * (1 + SLACK)
    return order[:, :b], bounds


def moved(x: np.ndarray, near: np.ndarray, bounds: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """(near, bounds) after centroids moved by `drift`, and how many rows were certified, tightened, put in order again and rescanned."""
    near, bounds = near.copy(), bounds.copy()
    b = near.shape[1]
    bounds[:, 0] = (bounds[:, 0] + drift[near[:, 0]]) * (1 + SLACK)
    loss = np.column_stack([drift[near[:, 1:]], np.full(len(x), drift.max(initial=0.0))])
    low = bounds[:, 1:]
    held = np.isfinite(low)
    low[held] -= (loss + SLACK * (np.where(held, np.abs(low), 0) + loss))[held]
    beyond = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]  # no centroid after place z is nearer than beyond[:, z]
    doubt = np.flatnonzero(~(bounds[:, 0] < beyond[:, 0]))
    told = {"certified": len(x) - len(doubt)}
    bounds[doubt, 0] = np.sqrt(own_squared(x[doubt], centroids, near[doubt, 0]).astype(float)) * (1 + SLACK)
    within = bounds[doubt, :1] < beyond[doubt]
    first = np.where(within.any(1), within.argmax(1), b)
    told["tightened"] = int((first == 0).sum())
    for z in range(1, b):
        rows = doubt[first == z]
        some = np.sort(near[rows, : z + 1], axis=1)
        exact = ((x[rows, None, :] - centroids[some]) ** 2).sum(2)
        order = np.argsort(exact, axis=1, kind="stable")
        far = np.sqrt(np.take_along_axis(exact, order, 1).astype(float))
        near[rows, : z + 1] = np.take_along_axis(some, order, 1)
        bounds[rows, 1 : z + 1] = far[:, 1:] * (1 - SLACK)
        bounds[rows, 0] = far[:, 0] * (1 + SLACK)
    told["ordered"] = int(((first > 0) & (first < b)).sum())
    rows = doubt[first == b]
    near[rows], bounds[rows] = compared(x[rows], centroids, b)
    told["rescanned"] = len(rows)
    return near, bounds, told


def _lists(values: np.ndarray, kind) -> pa.ListArray:
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, max(d, 1), dtype=np.int32) if d else np.zeros(n + 1, np.int32)), pa.array(values.ravel(), kind))


def _moves(x: np.ndarray, was: np.ndarray | None, now: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids whose vectors changed, by how many, and by what sum."""
    rows = np.arange(len(x)) if was is None else np.flatnonzero(was != now)
    size, total = np.zeros(count, np.int64), np.zeros((count, x.shape[1]), np.int64)
    np.add.at(size, now[rows], 1)
    np.add.at(total, now[rows], x[rows])
    if was is not None:
        np.add.at(size, was[rows], -1)
        np.add.at(total, was[rows], -x[rows])
    used = np.unique(now[rows] if was is None else np.concatenate([now[rows], was[rows]]))
    return used, size[used], total[used]


_SCHEMA = "kind string, id long, v array<int>, near array<int>, bounds array<double>, cluster int, n long, total array<long>"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _assigned(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, nearby: int) -> str:
    """Write rows with their bounds for these centroids, and the moves of each batch; the folder's path."""

    def run(batches):
        one_thread()
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(1).flatten().to_numpy().reshape(len(batch), -1).astype(np.int64)
            if drift is None:
                was, (near, bounds) = None, compared(x, centroids, nearby)
            else:
                old = batch.column(2).flatten().to_numpy().reshape(len(batch), -1).astype(np.int64)
                was = old[:, 0]
                near, bounds, _ = moved(x, old, batch.column(3).flatten().to_numpy().reshape(len(batch), -1), centroids, drift)
            used, size, total = _moves(x, was, near[:, 0], len(centroids))
            n, m = len(batch), len(used)
            none = lambda kind, k: pa.nulls(k, kind)
            ints, longs, reals = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(["rows"] * n), batch.column(0), batch.column(1), _lists(near, pa.int32()), _lists(bounds, pa.float64()), none(pa.int32(), n), none(pa.int64(), n), none(longs, n)], names=_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(["sums"] * m, pa.string()), none(pa.int64(), m), none(ints, m), none(ints, m), none(reals, m), pa.array(used, pa.int32()), pa.array(size), _lists(total, pa.int64())], names=_NAMES)

    path = shared_dir(rows.sparkSession, "bounds")
    rows.mapInArrow(run, _SCHEMA).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return passing(rows.sparkSession, path)



def _part(spark, path: str, kind: str, columns: list[str]) -> DataFrame:
    """Rows of one kind; the other's folder isn't read."""
    return spark.read.schema(_SCHEMA).parquet(path).where(F.col("kind") == kind).select(columns)


def cluster(rows: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS, nearby: int = NEARBY) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of each row of (id, v), final centroids), after `rounds` rounds from these centroids.

    A round assigns every row to its nearest centroid, ties to the smaller number, and moves each
    centroid that has rows to the floor of their mean. Then rows are assigned once more. Repeated
    rows count each. The result is written; no rows, or no centroids, give no rows.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long"), centroids
    size, total = np.zeros(len(centroids), object), np.zeros(centroids.shape, object)
    path = _assigned(rows, centroids, None, nearby)
    for _ in range(rounds):
        sums = _part(spark, path, "sums", ["cluster", "n", "total"])
        sums = sums.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        for r in sums.collect():  # a row for each component of each centroid
            total[r.cluster, r.at] += r.x
            size[r.cluster] += r.n if r.at == 0 else 0
        new = np.array([[int(x) // int(n) for x in own] if n else old for own, n, old in zip(total, size, centroids.tolist(), strict=True)], np.int64)
        drift = np.sqrt(((new - centroids).astype(float) ** 2).sum(1)) * (1 + SLACK)
        last, centroids = path, new
        path = _assigned(_part(spark, last, "rows", ["id", "v", "near", "bounds"]), centroids, drift, nearby)
        drop(spark, last)
    final = centroids

    def run(batches):
        for batch in batches:
            if len(batch):
                x = batch.column(1).flatten().to_numpy().reshape(len(batch), -1).astype(np.int64)
                own = batch.column(2).flatten().to_numpy().reshape(len(batch), -1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array(own_squared(x, final, own))], names=["id", "cluster", "distance"])

    out = kept(_part(spark, path, "rows", ["id", "v", "near"]).mapInArrow(run, "id long, cluster int, distance long"), "clusters")
    drop(spark, path)
    return out, final


def centroid_clusters(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", count: int = COUNT, rounds: int = ROUNDS, nearby: int = NEARBY, length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """(id column, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of `length` finite components.

    Vectors that are null, of another length, or hold null or non-finite components take no part. A
    null id stays null and chooses first centroids as an empty text would. Repeated rows count each,
    and fewer vectors than `count` have so many centroids; equal centroids leave all but the smallest
    number empty. Components beyond LARGEST raise an error; so do sums of squared distances that no
    long holds. Other columns are left out. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_column, column, length, scale)
    got, centroids = cluster(rows, first_centroids(rows, count), rounds, nearby)
    sums = got.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid
    whole = sum(int(r.s) for r in sums)
    if whole >= 1 << 63:
        raise OverflowError("the sum of squared distances doesn't fit a long")
    of = {r.cluster: int(r.s) for r in sums}
    facts = [(c, of.get(c, 0), whole, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return got.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_drake(spark, sf_dir: str) -> DataFrame:
    """Every vector of embeddings that takes part. Nulls, other lengths, repeats: see centroid_clusters."""
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "cells AS MATERIALIZED (SELECT rid, unnest(range(1, 65)) AS j, unnest(v) AS x FROM kept)",
        "seeds AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT 16))",
        "c0 AS MATERIALIZED (SELECT c, unnest(range(1, 65)) AS j, unnest(v) AS y FROM seeds)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"d{r} AS MATERIALIZED (SELECT rid, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM cells JOIN c{r} USING (j) GROUP BY rid, c)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)")
        if r < ROUNDS:
            steps.append(f"m{r} AS (SELECT a.c, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS y FROM a{r} a JOIN cells USING (rid) GROUP BY a.c, j)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, o.j, coalesce(m.y, o.y) AS y FROM c{r} o LEFT JOIN m{r} m ON o.c = m.c AND o.j = m.j)")
    steps.append(f"names AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY j)) AS h FROM c{ROUNDS} GROUP BY c)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (rid) JOIN names ON names.c = a.c"""


OP12_SQL = _sql()
