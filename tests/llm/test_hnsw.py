import numpy as np
import pytest

from assaykit.llm.hnsw import Shard, nearest


def exact(ids, vectors, every, k):
    out = []
    score = vectors @ vectors.T
    for q in np.flatnonzero(ids % every == 0):
        order = [j for j in np.lexsort((ids, -score[q])) if j != q][:k]
        out += [(int(ids[q]), r + 1, int(ids[j]), float(score[q, j])) for r, j in enumerate(order)]
    return out


def found(table, **how):
    return [tuple(r) for r in nearest(table, **how).orderBy("query_id", "rank").collect()]


def recall(got, want):
    got, want = {(a, c) for a, _, c, _ in got}, {(a, c) for a, _, c, _ in want}
    return len(got & want) / len(want)


@pytest.mark.parametrize("stretch", [False, True])
def test_recall_of_a_shard(stretch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 48)).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if stretch:
        x *= rng.uniform(0.2, 3, (6000, 1))
    ids = rng.permutation(20_000)[:6000]
    shard = Shard.made(ids, np.arange(1, len(x) + 1), x)
    assert [len(z) for z in shard.layers] == sorted((len(z) for z in shard.layers), reverse=True) and len(shard.layers) > 1
    q = np.flatnonzero(ids % 20 == 0)
    row, found, score = shard.search(ids[q], x[q], 20)
    want = exact(ids, x, 20, 20)
    got = {(int(ids[q][r]), int(i)) for r, i in zip(row, found, strict=True)}
    assert len(got) == len(want)
    assert len(got & {(a, c) for a, _, c, _ in want}) / len(want) > 0.95
    place = {int(i): n for n, i in enumerate(ids)}
    assert all(abs(s - x[q][r] @ x[place[int(i)]]) < 1e-12 for r, i, s in zip(row[:500], found[:500], score[:500], strict=True))


@pytest.mark.parametrize("shard_size", [60, 200, 5000])
def test_query_with_ties_and_odd_rows(spark, shard_size):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8))
    x[100:400] = x[0]
    x[5] = x[0] * 3
    ids, vectors = [*range(900), 20, 100, 105, 7], [*x, x[20], x[100], x[7], x[20]]  # rows that repeat, and ids that do
    odd = [(1000, None, 1), (1020, [0.0] * 8, 1), (1040, [float("nan")] * 8, 1), (1060, [None] + [1.0] * 7, 1), (1100, [], 1), (None, [1.0] * 8, 1), (1120, [float("inf")] + [1.0] * 7, 1)]
    rows = [(int(i), v.tolist(), 1) for i, v in zip(ids, vectors, strict=True)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score int")
    got, want = found(table, shard_size=shard_size, share=1.0), exact(np.array(ids), np.array(vectors), 20, 20)
    key = lambda r: (r[0], r[1], round(-r[3], 9), r[2])  # noqa: E731  of an id's two queries, ranks stand side by side
    assert [r[:3] for r in sorted(got, key=key)] == [r[:3] for r in sorted(want, key=key)]
    assert np.allclose([r[3] for r in sorted(got, key=key)], [r[3] for r in sorted(want, key=key)])


def test_each_length_by_itself(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [3.0]), (20, [5.0]), (3, [-1.0]), (40, [1.0, 0.0, -0.0]), (60, [7.0] * 300)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [r[:3] for r in got] == [(0, 1, 1), (20, 1, 2), (20, 2, 3)]


def test_routed_shards(spark, monkeypatch):
    """Ten thousand vectors about centres: graphs of many shards, of which a query visits a few."""
    from assaykit.llm import hnsw

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32)) * 3
    x = np.concatenate([centres[rng.integers(0, 40, 7000)], np.repeat(centres[:1], 3000, 0)]) + rng.normal(size=(10_000, 32))
    ids = rng.permutation(10_000)
    table = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "vec_id long, embedding array<double>").repartition(4)
    seen, needed = [], hnsw._needed
    monkeypatch.setattr(hnsw, "_needed", lambda *a: seen.append((needed(*a)[32], len(a[2].centroids[32]), a[2].first[32][-1])) or needed(*a))
    want = exact(ids, x, 20, 20)
    got = found(table, shard_size=500)
    assert len(got) == len(want) and recall(got, want) > 0.95
    place = {int(i): n for n, i in enumerate(ids)}
    assert all(abs(s - x[place[a]] @ x[place[c]]) < 1e-9 for a, _, c, s in got)
    [(visited, centroids, shards)] = seen
    assert visited <= centroids // 2 and shards >= centroids == 20


def test_fewer_candidates_and_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0]), (40, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r[:3] for r in found(table)] == [(0, 1, 2), (0, 2, 1), (0, 3, 40), (40, 1, 0), (40, 2, 2), (40, 3, 1)]
    assert nearest(table.limit(0)).count() == 0
    assert nearest(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_recall_on_the_given_vectors(spark):
    d = "/root/testdata/sf0.01/embeddings.parquet"
    t = spark.read.parquet(d)
    rows = t.orderBy("vec_id").collect()
    want = {(a, c) for a, _, c, _ in exact(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows]), 20, 20)}
    got = {(r.query_id, r.vec_id) for r in nearest(t).collect()}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


@pytest.mark.parametrize("norms", ["one long", "very long", "pareto", "lognormal", "huge and tiny"])
def test_recall_at_any_lengths(spark, norms):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    size = {"one long": np.where(np.arange(3000) == 7, 1e4, 1.0), "very long": np.where(np.arange(3000) == 7, 1e6, 1.0), "pareto": rng.pareto(1, 3000) + 1, "lognormal": rng.lognormal(0, 3, 3000), "huge and tiny": 10.0 ** rng.uniform(-20, 20, 3000)}[norms]
    x *= size[:, None]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = found(table, shard_size=800), exact(np.arange(3000), x, 20, 20)
    assert len(got) == len(want) and recall(got, want) >= 0.95
