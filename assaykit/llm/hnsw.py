"""Approximate nearest neighbours by inner product: a small-world graph per shard, results merged.

Vectors get one component more, which makes all of a shard equally long, so that the largest inner
product with a query is the smallest angle. Single precision holds that component only among vectors whose
lengths are alike, so vectors are first told apart by length: those over an eighth of the longest, those
over a 64th, and so on, each range with shards of its own. Equal vectors are one node, with as many of their ids as
can be among the nearest. Shards hold vectors that lie together: those nearest to one of some
centroids, fitted on a bounded sample. How many centroids' shards a query has to visit is measured: a
bounded sample of queries visits all, and the others as many as hold the wanted share of what these
found. Nodes are ordered by falling level, so each layer's nodes are the first ones and its
neighbours one flat array with a fixed number of places for each node. Nodes are put in by batches,
each searched in the graph of all before it; neighbours are picked by the usual rule that a candidate
must be nearer to the node than to any picked one. Walks run for many queries at once. Distances of
the walk are in single precision; scores of what it finds are inner products of the original vectors
in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import bound_batches, forget, kept, one_thread, table

#: Vectors of a shard, about; neighbours of a node above the ground layer, on it; widths of the searches.
SHARD, ABOVE, GROUND, BUILD_WIDTH, WIDTH, UPPER_WIDTH = 16_384, 16, 32, 96, 160, 8
#: Nodes put in at once; candidates opened at once; queries that visit one copy of a shard, about.
BATCH, OPEN, VISITS = 512, 4, 16_384
#: Most centroids, and vectors that they are fitted on; queries that measure visits, and the share they must find.
CENTROIDS, FITTED, MEASURED, SHARE = 4096, 65_536, 256, 0.97
#: A range of lengths spans so many powers of two; rows that are compared with all centroids at once.
OCTAVES, BLOCK = 3, 1024
#: A kind is a number of components and a range of lengths, the longest being 0, in one long: components + KINDS * range.
KINDS = 1 << 32


def _levels(ids: np.ndarray) -> np.ndarray:
    """Geometric levels from a hash of the ids: the same whenever the index is built."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
    return np.floor(-np.log(np.maximum(u, 1e-18)) / math.log(ABOVE)).astype(np.int64)


def walk(points: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all queries at once: (ids, products), best first, -1 where none.

    start: ids to begin from, one row for each query, -1 where none.
    """
    n, rows = len(queries), np.arange(len(queries))
    ids = np.full((n, width), -1, np.int64)
    near = np.full((n, width), -np.inf, np.float32)
    opened = np.ones((n, width), bool)
    met = np.zeros((n, len(links)), bool)
    start = start[:, :width]
    ok = start >= 0
    safe = np.where(ok, start, 0)
    met[np.repeat(rows, ok.sum(1)), start[ok]] = True
    ids[:, : start.shape[1]] = start
    near[:, : start.shape[1]] = np.where(ok, np.einsum("nd,nkd->nk", queries, points[safe]), -np.inf)
    opened[:, : start.shape[1]] = ~ok
    act = rows
    while len(act):
        waiting = np.where(opened[act], -np.inf, near[act])
        best = np.argpartition(-waiting, min(OPEN, width) - 1, axis=1)[:, :OPEN]
        fresh = np.take_along_axis(waiting, best, 1) > -np.inf
        some = fresh.any(1)
        act, best, fresh = act[some], best[some], fresh[some]
        if not len(act):
            break
        opened[act[:, None], best] = True
        nodes = np.where(fresh, ids[act[:, None], best], 0)
        found = np.where(fresh[:, :, None], links[nodes], -1).reshape(len(act), -1)
        found = np.where((found >= 0) & ~met[act[:, None], np.maximum(found, 0)], found, -1)
        found = -np.sort(-found, axis=1)  # one node may be met twice at once
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        most = int((found >= 0).sum(1).max(initial=0))
        if most == 0:
            continue
        found = -np.sort(-found, axis=1)[:, :most]
        ok = found >= 0
        met[np.repeat(act, ok.sum(1)), found[ok]] = True
        at = np.nonzero(ok)
        gain = np.full(found.shape, -np.inf, np.float32)
        gain[at] = np.einsum("kd,kd->k", queries[act[at[0]]], points[found[at]])
        all_ids = np.concatenate([ids[act], found], 1)
        all_near = np.concatenate([near[act], gain], 1)
        all_open = np.concatenate([opened[act], ~ok], 1)
        best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        ids[act] = np.take_along_axis(all_ids, best, 1)
        near[act] = np.take_along_axis(all_near, best, 1)
        opened[act] = np.take_along_axis(all_open, best, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    return np.where(near > -np.inf, np.take_along_axis(ids, order, 1), -1), near


def pick(points: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` neighbours for each row of candidates (best first, -1 where none).

    A candidate is picked if it is nearer to the row's node than to all picked ones; places left
    go to the nearest of the others.
    """
    n, k = ids.shape
    own = points[np.maximum(ids, 0)]
    pair = own @ own.transpose(0, 2, 1)
    taken = np.zeros((n, k), bool)
    for j in range(k):
        closest = np.where(taken, pair[:, j], -np.inf).max(1)
        taken[:, j] = (ids[:, j] >= 0) & (near[:, j] > closest) & (taken.sum(1) < most)
    rank = np.where(taken, 0, np.where(ids >= 0, 1, 2)) * k + np.arange(k)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < most:
        out = np.concatenate([out, np.full((n, most - out.shape[1]), -1, out.dtype)], 1)
    return out


def _put(points: np.ndarray, links: np.ndarray, new: np.ndarray, ids: np.ndarray, near: np.ndarray) -> None:
    """Give new nodes their neighbours in a layer, and these the new nodes, within its places."""
    places = links.shape[1]
    chosen = pick(points, ids, near, min(ABOVE, places))
    links[new, : chosen.shape[1]] = chosen
    to, back = chosen.ravel(), np.repeat(new, chosen.shape[1])
    to, back = to[to >= 0], back[to >= 0]
    gain = np.einsum("kd,kd->k", points[to], points[back])
    order = np.lexsort((-gain, to))
    to, back = to[order], back[order]
    begin = np.flatnonzero(np.diff(to, prepend=-1))
    which = np.cumsum(np.diff(to, prepend=-1) != 0) - 1
    place = np.arange(len(to)) - begin[which]
    nodes = to[begin]
    extra = np.full((len(nodes), min(places, int(place.max(initial=0)) + 1)), -1, np.int64)
    fits = place < extra.shape[1]  # the nearest of them, if more come than there are places
    extra[which[fits], place[fits]] = back[fits]
    now = np.concatenate([links[nodes], extra], 1)
    now = -np.sort(-now, axis=1)
    now[:, 1:][now[:, 1:] == now[:, :-1]] = -1
    close = np.where(now >= 0, np.einsum("nd,nkd->nk", points[nodes], points[np.maximum(now, 0)]), -np.inf)
    order = np.argsort(-close, axis=1, kind="stable")
    now, close = np.take_along_axis(now, order, 1), np.take_along_axis(close, order, 1)
    full = (now >= 0).sum(1) > places
    links[nodes[~full]] = now[~full][:, :places]
    for at in range(0, int(full.sum()), BATCH):
        some = np.flatnonzero(full)[at : at + BATCH]
        links[nodes[some]] = pick(points, now[some], close[some], places)


def build(points: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    """Flat neighbour arrays, ground layer first; levels must fall."""
    n = len(points)
    sizes = [int((levels >= k).sum()) for k in range(int(levels[0]) + 1)]
    layers = [np.full((size, GROUND if k == 0 else ABOVE), -1, np.int64) for k, size in enumerate(sizes)]
    at = 1
    while at < n:
        new = np.arange(at, min(n, at + max(1, min(BATCH, at // 2))))
        start = np.zeros((len(new), 1), np.int64)
        among = points[new] @ points[new].T
        among[np.triu_indices(len(new))] = -np.inf  # of its own batch a node sees those before it
        for k in range(len(layers) - 1, -1, -1):
            size = min(at, sizes[k])
            inside = new < sizes[k]
            ids, near = walk(points, layers[k][:size], points[new], start, BUILD_WIDTH if inside.any() else UPPER_WIDTH)
            if inside.any():
                peers = among[inside][:, inside]
                m = min(GROUND, peers.shape[1])
                best = np.argpartition(-peers, m - 1, axis=1)[:, :m]
                gain = np.take_along_axis(peers, best, 1)
                both = np.concatenate([ids[inside], np.where(gain > -np.inf, new[inside][best], -1)], 1)
                close = np.concatenate([near[inside], gain], 1)
                order = np.argsort(-close, axis=1, kind="stable")[:, :BUILD_WIDTH]
                _put(points, layers[k], new[inside], np.take_along_axis(both, order, 1), np.take_along_axis(close, order, 1))
            start = ids[:, :UPPER_WIDTH]
        at = int(new[-1]) + 1
    return layers


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """Vectors over the largest length, with the component that makes all of them equally long."""
    x = vectors / np.abs(vectors).max()
    square = (x * x).sum(1)
    return np.column_stack([x, np.sqrt(np.maximum(square.max() - square, 0))]) / math.sqrt(square.max())


class Shard:
    """ids: a node's ids one after the other, rising; ends: where they end; vectors: a node's; layers."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, vectors: np.ndarray, layers: list[np.ndarray]):
        self.ids, self.ends, self.vectors, self.layers = ids, ends, vectors, layers
        self.points = lengthened(vectors).astype(np.float32)

    @classmethod
    def made(cls, ids: np.ndarray, ends: np.ndarray, vectors: np.ndarray) -> Shard:
        """From distinct vectors in any order, with their ids."""
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        order = np.argsort(ids[begin], kind="stable")
        levels = _levels(ids[begin[order]])
        by_level = np.argsort(-levels, kind="stable")
        order, levels = order[by_level], levels[by_level]
        many = (ends - begin)[order]
        at = np.repeat(begin[order] - np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64), many) + np.arange(many.sum())
        shard = cls(ids[at], np.cumsum(many), vectors[order], [])
        shard.layers = build(shard.points, levels)
        return shard

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of queries, id, product) of the k best found for each query but the query's own row."""
        n = len(queries)
        scaled = queries / np.maximum(np.abs(queries).max(1, keepdims=True), 1e-300)
        points = np.column_stack([scaled, np.zeros(n)]).astype(np.float32)
        near = np.zeros((n, 1), np.int64)
        for layer in self.layers[:0:-1]:
            near = walk(self.points, layer, points, near, UPPER_WIDTH)[0]
        near = walk(self.points, self.layers[0], points, near, max(WIDTH, 4 * k))[0]
        row, at = np.nonzero(near >= 0)
        node = near[row, at]
        score = np.einsum("kd,kd->k", queries[row], self.vectors[node])
        same = (queries[row] == self.vectors[node]).all(1)
        begin = np.concatenate([[0], self.ends[:-1]])[node]
        many = np.minimum(self.ends[node] - begin, k + 1)  # of equal vectors no more can be among the k best
        item = np.repeat(begin - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        row, score, same, ids = np.repeat(row, many), np.repeat(score, many), np.repeat(same, many), self.ids[item]
        me = np.flatnonzero(same & (ids == own[row]))
        me = me[np.unique(row[me], return_index=True)[1]]  # another row of that id and vector isn't the query's own
        row, score, ids = (np.delete(x, me) for x in (row, score, ids))
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        return row[rank < k], ids[rank < k], score[rank < k]


class Router:
    """Centroids of each kind of vectors, and where their shards begin: centroid c of kind d has shards first[d][c] to first[d][c + 1] - 1."""

    def __init__(self):
        self.reach: dict[int, float] = {}
        self.centroids: dict[int, np.ndarray] = {}
        self.first: dict[int, np.ndarray] = {}

    def points(self, d: int, x: np.ndarray) -> np.ndarray:
        """Vectors of kind d with the component that makes all of them equally long."""
        x = x / self.reach[d]
        return np.column_stack([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))])

    def fit(self, d: int, longest: float, sample: np.ndarray, centroids: int, rounds: int = 8) -> None:
        self.reach[d] = longest
        x = self.points(d, sample)
        c = x[: max(1, min(centroids, len(x)))]
        for _ in range(rounds):
            own = _blocks(x, lambda part, c=c: (part @ c.T).argmax(1))
            total = np.zeros_like(c)
            np.add.at(total, own, x)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
        self.centroids[d] = c

    def place(self, d: int, vectors: np.ndarray) -> np.ndarray:
        return _blocks(vectors, lambda part: (self.points(d, part) @ self.centroids[d].T).argmax(1))

    def order(self, d: int, queries: np.ndarray) -> np.ndarray:
        """Centroids in the order in which a query visits them."""
        x = queries / np.abs(queries).max(1, keepdims=True)  # of any length, without overflow
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return _blocks(x, lambda part: np.argsort(-(part @ self.centroids[d][:, :-1].T), axis=1, kind="stable"))

    def kinds(self, components: int) -> list[int]:
        """Kinds of vectors with so many components that have shards."""
        return [d for d in sorted(self.centroids) if d % KINDS == components and self.first[d][-1] > self.first[d][0]]


def _blocks(x: np.ndarray, run) -> np.ndarray:
    """run over blocks of rows, so that no product with all centroids is large."""
    return np.concatenate([run(x[k : k + BLOCK]) for k in range(0, max(1, len(x)), BLOCK)])


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v) of each row with an id whose vector is finite and not all zero; no negative zeros."""
    v = F.transform(F.col(column).cast("array<double>"), lambda x: x + F.lit(0.0))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))


def _nodes(rows: DataFrame, k: int) -> DataFrame:
    """(v, n, l, ids): distinct vectors, their components' number, their length's logarithm, and their k + 1 smallest ids; no more of them can be among a query's k nearest."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("r", rank).where(F.col("r") <= k + 1)
    most = F.array_max(F.transform("v", F.abs))  # lengths without overflow
    part = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / most) * (x / most))
    return few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("v", F.size("v").cast("long").alias("n"), (F.log2(most) + F.log2(part) / 2).alias("l"), "ids")


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _by_kind(lengths: np.ndarray):
    """(number, places of the rows that have it)."""
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    return [(int(lengths[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def build_index(rows: DataFrame, k: int = 20, shard_size: int = SHARD) -> tuple[DataFrame, Router]:
    """Index of rows (id, v), good for k nearest, as a written table (shard, part, layer, data), and what routes queries to its shards.

    Vectors of each number of components, and of each range of lengths, have shards of their own. Centroids: one for each shard_size vectors,
    CENTROIDS at most, fitted on at most FITTED of them, chosen by a hash. A centroid with more
    vectors than two shards hold has several, dealt by a hash. Repeated rows count each. No rows
    give no shards.
    """
    spark = rows.sparkSession
    vectors = kept(_nodes(rows, k), "vectors")
    longest = [(r.n, r.longest) for r in vectors.groupBy("n").agg(F.max("l").alias("longest")).collect()]  # a row for each number of components
    longest = F.broadcast(spark.createDataFrame(longest or [(0, 0.0)], "n long, longest double"))
    nodes = vectors.join(longest, "n").select("v", (F.col("n") + KINDS * F.floor((F.col("longest") - F.col("l")) / OCTAVES)).alias("d"), "l", "ids")
    router = Router()
    for r in nodes.groupBy("d").agg(F.count("*").alias("n"), F.max("l").alias("l")).collect():  # a row for each kind
        centroids = min(CENTROIDS, math.ceil(r.n / shard_size))
        few = min(FITTED, 64 * centroids)
        chosen = nodes.where((F.col("d") == r.d) & (F.xxhash64("v") <= F.lit(min((1 << 63) - 1, (2 * few << 64) // r.n - (1 << 63))).cast("long")))
        sample = chosen.orderBy(F.xxhash64(F.lit(1), "v"), "v").limit(few).select("v").toArrow()
        if len(sample) == 0:
            sample = nodes.where(F.col("d") == r.d).select("v").limit(1).toArrow()
        router.fit(r.d, 2.0 ** min(r.l + 1e-9, 1023.9), _matrix(sample.column("v").combine_chunks(), r.d % KINDS), centroids)
    routed = spark.sparkContext.broadcast(router)

    def place(batches):
        one_thread()
        for batch in batches:
            found = np.zeros(len(batch), np.int64)
            for d, part in _by_kind(batch.column(1).to_numpy()):
                found[part] = routed.value.place(d, _matrix(batch.column(0).take(pa.array(part)), d % KINDS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "centroid"])

    placed = kept(nodes.select("v", "d", "ids").mapInArrow(place, "v array<double>, d long, ids array<long>, centroid long"), "placed")
    forget(vectors)
    sizes = {(r.d, r.centroid): r.n for r in placed.groupBy("d", "centroid").agg(F.count("*").alias("n")).collect()}  # a row for each centroid
    shards, spread = 0, []
    for d in sorted(router.centroids):
        router.first[d] = np.zeros(len(router.centroids[d]) + 1, np.int64)
        for c in range(len(router.centroids[d])):
            n = sizes.get((d, c), 0)
            many = max(1, n // (2 * shard_size) + 1) if n else 0
            router.first[d][c] = shards
            spread.append((d, c, shards, max(1, many)))
            shards += many
        router.first[d][-1] = shards
    starts = F.broadcast(spark.createDataFrame(spread or [(0, 0, 0, 1)], "d long, centroid long, start long, many long"))
    dealt = placed.join(starts, ["d", "centroid"]).select((F.col("start") + F.pmod(F.xxhash64("v"), F.col("many"))).alias("shard"), "v", "ids")

    def run(batches):
        one_thread()
        now, vectors, ids = None, [], []

        def done():
            lists = pa.concat_arrays(ids)
            s = Shard.made(lists.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(lists).to_numpy()), np.concatenate(vectors))
            parts = [("ids", 0, s.ids.astype("<i8")), ("ends", 0, s.ends.astype("<i8")), ("vectors", s.vectors.shape[1], s.vectors.astype("<f8"))]
            parts += [("layer", k, x.astype("<i4")) for k, x in enumerate(s.layers)]
            m = len(parts)
            return pa.RecordBatch.from_arrays([pa.array([now] * m, pa.int64()), pa.array([p[0] for p in parts]), pa.array([p[1] for p in parts], pa.int64()), pa.array([p[2].tobytes() for p in parts], pa.binary())], names=["shard", "part", "layer", "data"])

        for batch in batches:
            owner = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if owner[lo] != now:
                    if vectors:
                        yield done()
                    now, vectors, ids = int(owner[lo]), [], []
                piece = batch.column(1).slice(lo, hi - lo)
                vectors.append(_matrix(piece, len(piece.flatten()) // (hi - lo)).copy())
                ids.append(pa.array(batch.column(2).slice(lo, hi - lo).to_pylist(), pa.list_(pa.int64())))
        if vectors:
            yield done()

    apart = dealt.repartitionById(max(1, shards), F.col("shard").cast("int")).sortWithinPartitions("shard")
    index = kept(apart.mapInArrow(run, "shard long, part string, layer long, data binary"), "hnsw")
    forget(placed)
    return index, router


def _walked(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, query_id, shard, vec_id, score: what queries asked (query, id, v, shard) find in their shards.

    A shard that many visit has copies, and a copy with its queries is a partition of its own.
    """
    spark = index.sparkSession
    visits = {r.shard: r.n for r in asked.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row for each shard
    copies = [(s, -(-n // VISITS)) for s, n in sorted(visits.items())]
    at, rows = 0, []
    for s, many in copies:
        rows.append((s, at, many))
        at += many
    starts = F.broadcast(spark.createDataFrame(rows or [(-1, 0, 1)], "shard long, start int, many int"))

    def run(batches):
        one_thread()
        now, parts, shard = None, {}, None
        for batch in batches:
            is_query = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            owner = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(owner) != 0) | (np.diff(is_query) != 0)) + 1).tolist(), len(owner)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if owner[lo] != now:
                    now, parts, shard = owner[lo], {}, None
                piece = batch.slice(lo, hi - lo)
                if not is_query[lo]:
                    for part, layer, data in zip(*(piece.column(c).to_pylist() for c in (3, 4, 5)), strict=True):
                        parts[part, layer if part == "layer" else 0] = (layer, data)
                    continue
                if shard is None:
                    width, data = parts["vectors", 0]
                    layers = [np.frombuffer(parts["layer", j][1], "<i4").reshape(-1, ABOVE if j else GROUND).astype(np.int64) for j in range(sum(p == "layer" for p, _ in parts))]
                    shard = Shard(np.frombuffer(parts["ids", 0][1], "<i8"), np.frombuffer(parts["ends", 0][1], "<i8"), np.frombuffer(data, "<f8").reshape(-1, width), layers)
                    parts = {}
                query, own = piece.column(6).to_numpy(), piece.column(7).to_numpy()
                vectors = _matrix(piece.column(8), shard.vectors.shape[1])
                home = int(piece.column(1)[0].as_py())
                for b in range(0, len(own), BATCH):
                    row, ids, score = shard.search(own[b : b + BATCH], vectors[b : b + BATCH], k)
                    yield pa.RecordBatch.from_arrays([pa.array(query[b : b + BATCH][row]), pa.array(own[b : b + BATCH][row]), pa.array(np.full(len(row), home)), pa.array(ids), pa.array(score)], names=["query", "query_id", "shard", "vec_id", "score"])

    none = {c: F.lit(None).cast(t) for c, t in (("part", "string"), ("layer", "long"), ("data", "binary"), ("query", "long"), ("id", "long"), ("v", "array<double>"))}
    order = ["copy", "shard", "asked", "part", "layer", "data", "query", "id", "v"]
    stored = index.join(starts, "shard").withColumn("copy", F.explode(F.sequence("start", F.col("start") + F.col("many") - 1)))
    stored = stored.withColumns({"asked": F.lit(0)} | {c: none[c] for c in ("query", "id", "v")}).select(order)
    asked = asked.join(starts, "shard").withColumn("copy", F.col("start") + F.pmod(F.xxhash64("query"), F.col("many")).cast("int"))
    asked = asked.withColumns({"asked": F.lit(1)} | {c: none[c] for c in ("part", "layer", "data")}).select(order)
    both = stored.unionByName(asked).repartitionById(max(1, at), "copy").sortWithinPartitions("copy", "asked")
    return both.mapInArrow(run, "query long, query_id long, shard long, vec_id long, score double")


def search_index(index: DataFrame, router: Router, queries: DataFrame, k: int, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (id, v).

    MEASURED queries, chosen by a hash, visit all shards of their number of components; the others those of so
    many centroids of each kind, nearest first, that the measured ones would have found `share` of what
    they found there (all, if share is 1). A number of components without vectors finds nothing. Repeated queries are answered
    each. No queries give no rows. The result is written.
    """
    spark = queries.sparkSession
    routed = spark.sparkContext.broadcast(router)
    lengths = sorted({d % KINDS for d in router.centroids if router.first[d][-1] > router.first[d][0]})
    rows = queries.where(F.size("v").isin(lengths)).select(F.monotonically_increasing_id().alias("query"), "id", "v", (F.xxhash64("id", "v") % (1 << 30)).alias("h"))
    rows = kept(rows, "queries")
    edge = rows.orderBy("h").limit(MEASURED).agg(F.max("h")).first()[0]

    def visiting(some: DataFrame, most: dict[int, int] | None) -> DataFrame:
        def run(batches):
            r = routed.value
            for batch in batches:
                where: list = [None] * len(batch)
                for components, part in _by_kind(pa.compute.list_value_length(batch.column(2)).to_numpy()):
                    vectors = _matrix(batch.column(2).take(pa.array(part)), components)
                    visits: list[list] = [[] for _ in part]
                    for d in r.kinds(components):
                        begin, end = r.first[d][:-1], r.first[d][1:]
                        for own, to in zip(r.order(d, vectors)[:, : most[d] if most else None], visits, strict=True):
                            to += [np.arange(begin[c], end[c]) for c in own]
                    for p, to in zip(part.tolist(), visits, strict=True):
                        where[p] = np.concatenate(to)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.list_(pa.int64()))], names=["query", "id", "v", "shards"])

        found = some.select("query", "id", "v").mapInArrow(run, "query long, id long, v array<double>, shards array<long>")
        return found.select("query", "id", "v", F.explode("shards").alias("shard"))

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    columns = ["query_id", "rank", "vec_id", "score"]
    if edge is None or share >= 1 or all(len(c) == 1 for c in router.centroids.values()):
        out = kept(best(_walked(index, visiting(rows, None), k)).select(columns), "nearest")
    else:
        first = kept(best(_walked(index, visiting(rows.where(F.col("h") <= edge), None), k)), "measured")
        needed = _needed(first, rows.where(F.col("h") <= edge), router, share)
        rest = best(_walked(index, visiting(rows.where(F.col("h") > edge), needed), k))
        out = kept(first.select(columns).unionByName(rest.select(columns)), "nearest")
        forget(first)
    forget(rows)
    return out


def _needed(found: DataFrame, queries: DataFrame, router: Router, share: float) -> dict[int, int]:
    """For each kind, how many centroids hold `share` of what the measured queries found there (one, if they found nothing)."""
    vectors = {r.query: np.array(r.v) for r in queries.select("query", "v").collect()}  # MEASURED, about
    kinds = sorted(router.centroids)
    starts = np.array([router.first[d][0] for d in kinds])
    of = {d: [] for d in kinds}
    for r in found.select("query", "shard").collect():
        d = kinds[int(np.searchsorted(starts, r.shard, side="right")) - 1]
        of[d].append((r.query, int(np.searchsorted(router.first[d], r.shard, side="right")) - 1))
    out = {}
    for d, pairs in of.items():
        order = {q: np.argsort(router.order(d, vectors[q][None])[0]) for q in {q for q, _ in pairs}}
        places = sorted(int(order[q][c]) for q, c in pairs)
        out[d] = 1 + places[min(len(places) - 1, math.ceil(share * len(places)))] if places else 1
    return out


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_column: str = "vec_id", column: str = "embedding", shard_size: int = SHARD, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    Nearness is the largest inner product in double precision; ties go to the smaller id. Rows
    with a null id, a null, zero or empty vector, or null or non-finite components take no part. All
    others do: rows that share an id are queries and candidates each, and a vector's candidates are
    those with as many components. Other columns are left out. No rows give no rows.
    """
    bound_batches(vectors.sparkSession)
    rows = usable(vectors, id_column, column)
    index, router = build_index(rows, k, shard_size)
    out = search_index(index, router, rows.where(F.col("id") % every == 0), k, share)
    forget(index)
    return out


def op2_hnsw(spark, sf_dir: str) -> DataFrame:
    """Every row of embeddings as a candidate, those whose id 20 divides as queries. Rows that take no part: see nearest."""
    return nearest(table(spark, sf_dir, "embeddings"))
