import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assaykit.llm import simhash
from assaykit.llm import simhash
from assaykit.llm.components import components
from assaykit.llm.simhash import _keys, _linked, candidate_links, fingerprint, links, near_duplicates, representatives


def plain(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def texts(rng):
    words = ["alpha", "Beta", "GAMMA", "déjà", "e", "f", "g\x1ch", "i.", " j"]
    base = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 60, 300]))) for _ in range(30)]
    near = [t.replace("alpha", "alphas", 1) for t in base] + [t + " \n" for t in base[:9]]
    return [*base, *near, *base[:5], None, "", "   "]


def test_fingerprint():
    for t in texts(random.Random(1)):
        assert fingerprint(t) == plain(t)


def test_spark_hash_is_the_same(spark):
    got = spark.createDataFrame([("one two three",), ("déjà vu x",)], "s string").select("s", F.xxhash64("s").alias("h")).collect()
    assert all(r.h % 2**64 == xxhash.xxh64_intdigest(r.s.encode(), 42) for r in got)


def test_every_close_pair_shares_a_key_and_passes(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))))
    signed = lambda x: x - 2**64 if x >> 63 else x
    rows = [(signed(x), n) for n, p in enumerate(pairs) for x in p]
    got = spark.createDataFrame(rows, "fp long, n long").select("fp", F.explode(F.array(*_keys(F.col("fp")))).alias("key")).orderBy("key").toPandas()
    a, b = links(got.key.to_numpy(), got.key.to_numpy(), got.fp.to_numpy())
    found = {frozenset(x) for x in zip((a.astype(np.uint64)).tolist(), b.astype(np.uint64).tolist(), strict=True)}
    assert {frozenset(p) for p in pairs} <= found
    assert all((min(p) ^ max(p)).bit_count() <= 3 for p in found)


def test_large_bucket_and_batches():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    centre = np.uint64(rng.integers(2**63))
    fps = sorted({int(centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(np.arange(30, 64), rng.integers(0, 6), replace=False)))) for _ in range(400)})
    fp = np.array(fps, np.uint64).view(np.int64)
    key = np.zeros(len(fp), np.int64)
    cuts = [0, 5, 100, len(fp)]
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i:j])] * 3 + [pa.array(fp[i:j])], names=["key", "mask", "bits", "fp"]) for i, j in zip(cuts, cuts[1:], strict=False)]
    edges = [(a, b) for x in _linked(batches) for a, b in zip(*(np.array(c.to_pylist(), np.int64).view(np.uint64).tolist() for c in x.columns), strict=True)]
    assert len(edges) < len(fps)
    chain = lambda x: (x & (2**40 - 1)).bit_count() <= 1 and (x & (2**60 - 1)).bit_count() <= 2 and x.bit_count() <= 3
    label = {x: x for x in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        assert chain(a ^ b)
        label[root(a)] = root(b)
    assert all(root(a) == root(b) for a in fps for b in fps if chain(a ^ b))


def test_a_key_of_many_unlinked_fingerprints_is_split(spark):
    """All share 44 bits, so most keys hold all of them; most have no link, some do."""
    rng = random.Random(6)
    head = rng.getrandbits(44)
    own = {head | rng.getrandbits(20) << 44 for _ in range(700)}
    for x in rng.sample(sorted(own), 150):
        own.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))))
    fps = sorted(own)
    signed = lambda x: x - 2**64 if x >> 63 else x
    classes = spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(3)
    pairs, read = candidate_links(classes, limit=40)
    assert len(read) > 4
    edges = pairs.collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in edges)
    label = {x: x for x in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in edges:
        label[root(r.a % 2**64)] = root(r.b % 2**64)
    want = closure(fps)
    assert 1 < len(set(want)) < len(fps)
    assert all((root(fps[i]) == root(fps[j])) == (want[i] == want[j]) for i in range(len(fps)) for j in range(0, i, 7))


def test_a_very_long_text(spark):
    long = "stone river cloud " * 300_000
    docs = spark.createDataFrame([(1, long), (2, long + "x"), (3, "short"), (4, long)], "doc_id long, text string")
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in near_duplicates(docs).collect()}
    assert got[1] == got[2] == got[4] == (plain(long), 1) and got[3][1] == 3


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3), (41, 40), (41, 40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    t = texts(random.Random(5))
    rows = [(1000 - i, x, i) for i, x in enumerate(t)] + [(1000, t[0], 0), (1000, "quite another text of words", 1), (None, t[2], 2), (None, "only here in this row it is", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [plain(r[1]) for r in rows]
    label = closure(fps)
    least = {}
    for r, k in zip(rows, label, strict=True):
        least[k] = min(least.get(k, 10**9), 10**9 if r[0] is None else r[0])
    want = sorted((r[0] or -1, f, least[k] if least[k] < 10**9 else -1) for r, f, k in zip(rows, fps, label, strict=True))
    assert sorted((r.doc_id or -1, r.fp % 2**64, r.component_id if r.component_id is not None else -1) for r in got) == want
    stay = representatives(docs.withColumnRenamed("fp", "_text")).collect()
    assert len(stay) == len(set(label)) and stay[0].asDict().keys() == {"doc_id", "text", "_text"}
    assert sorted(label[fps.index(plain(r.text))] for r in stay) == sorted(set(label))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == representatives(empty).count() == 0


@pytest.mark.parametrize("few", [0, 10])
def test_repeated_rows_beside_single_ones(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(k, text(k), "a") for k in range(50)] + [(7, text(7), "b")] * 30 + [(60, text(3), "c"), (None, text(9), "d"), (None, text(99), "e"), (None, text(99), "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string").repartition(5)
    got = simhash.representatives(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == sorted([(False, k, text(k)) for k in range(50)] + [(True, 0, text(99))])
    assert docs.columns == ["doc_id", "text", "_key"]
