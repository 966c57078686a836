import hashlib
import math

import duckdb
import numpy as np
import pytest

from assaykit.llm.centroids import LARGEST, OP12_SQL, centroid_clusters, compared, moved, squared


def plain(rows, count=16, rounds=3):
    """The contract, with Python's whole numbers."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:count]
    centroids = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for r in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda c, v=v: (far(v, centroids[c]), c)) for _, v in kept]
        if r < rounds:
            groups = {c: [v for (_, v), o in zip(kept, own, strict=True) if o == c] for c in set(own)}
            centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else old for c, old in enumerate(centroids)]
    dist = [far(v, centroids[o]) for (_, v), o in zip(kept, own, strict=True)]
    return [(i, o, d, sum(e for e, p in zip(dist, own, strict=True) if p == o), sum(dist), hashlib.sha256(",".join(map(str, centroids[o])).encode()).hexdigest()) for (i, _), o, d in zip(kept, own, dist, strict=True)]


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize("spread", [0.15, 0.02, 40_000.0])
def test_contract_against_plain(spark, spread):
    rng = np.random.default_rng(int(spread * 100))
    x = (rng.normal(size=(300, 64)) * spread).tolist()
    x += [x[3]] * 40 + [[0.0] * 64] * 5  # ties and repeated vectors
    rows = [(k, v) for k, v in enumerate(x)] + [(3, x[3]), (None, x[7]), (None, x[8])]
    odd = [(900, None), (901, []), (902, x[0][:63]), (903, [*x[0], 1.0]), (904, [None, *x[0][1:]]), (905, [float("nan"), *x[0][1:]]), (906, [float("-inf"), *x[0][1:]])]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + odd], "vec_id long, embedding array<double>, cluster int, distance double").repartition(5)
    assert got(centroid_clusters(table)) == sorted(plain(rows + odd), key=repr)


def test_few_rows_none_and_too_large(spark):
    kind = "vec_id long, embedding array<float>"
    few = [(k, [k / 8] * 64) for k in range(5)]
    assert got(centroid_clusters(spark.createDataFrame(few, kind))) == sorted(plain(few), key=repr)
    assert centroid_clusters(spark.createDataFrame([], kind)).count() == 0
    assert centroid_clusters(spark.createDataFrame([(1, [1.0])], kind)).count() == 0
    with pytest.raises(Exception, match="don't fit a long"):
        centroid_clusters(spark.createDataFrame([(1, [LARGEST / 32.0] * 64)], kind)).count()


def test_bounds_never_lie_and_save_work():
    rng = np.random.default_rng(5)
    middle = rng.integers(-200, 200, (40, 32))
    x = (middle[rng.integers(0, 40, 4000)] + rng.integers(-30, 30, (4000, 32))).astype(np.int64)
    x[100:200] = x[0]
    c = x[rng.choice(4000, 40, replace=False)].copy()
    near, bounds = compared(x, c, 5)
    skipped = 0
    for _ in range(8):
        own = near[:, 0]
        new = np.array([x[own == k].sum(0) // (own == k).sum() if (own == k).any() else c[k] for k in range(40)])
        drift, c = np.sqrt(((new - c) ** 2).sum(1)), new
        near, bounds, told = moved(x, near, bounds, c, drift)
        exact = squared(x, c)
        assert (near[:, 0] == exact.argmin(1)).all()
        far = np.sqrt(exact.astype(float))
        assert (bounds[:, 0] >= far[np.arange(4000), near[:, 0]]).all()
        assert (bounds[:, 1:-1] <= np.take_along_axis(far, near[:, 1:], 1)).all()
        far[np.arange(4000)[:, None], near] = np.inf
        assert (bounds[:, -1] <= far.min(1)).all() and sum(told.values()) == 4000
        skipped += told["certified"] + told["tightened"]
    assert skipped > 0.7 * 8 * 4000  # neither compared with other centroids nor put in order again


def test_distances_are_exact_at_any_size():
    rng = np.random.default_rng(6)
    for reach in (50, 1 << 20, LARGEST):
        x, c = rng.integers(-reach, reach + 1, (30, 64)), rng.integers(-reach, reach + 1, (7, 64))
        assert squared(x, c).tolist() == [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b, strict=True)) for b in c] for a in x]


def test_given_vectors_equal_sql(spark):
    from assaykit.llm.centroids import op12_drake

    d = "/root/testdata/sf0.1"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = duck.execute(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({OP12_SQL})").fetchall()
    assert got(op12_drake(spark, d)) == sorted(want, key=repr)
