import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from assaykit.llm.lexical import OP13_SQL, TERM, build_index, coded_terms, merge, op13_ranked_search, packed, search, unpacked


def terms(text):
    return re.findall(TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=50):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms_and_numbers():
    texts = ["Ab_c-D9", None, "", "...", "É\x7fé naïve\x00x", "日本語 TEXT"]
    codes, ends, distinct = coded_terms(pa.array(["drop", *texts]).slice(1))
    names = distinct.to_pylist()
    assert [[names[c] for c in codes[a:b]] for a, b in zip(ends, ends[1:])] == [terms(t) for t in texts]
    values = np.array([0, 1, 127, 128, 16383, 16384, (1 << 35) + 5, (1 << 62) + 7])
    assert unpacked(packed(values)[0]).tolist() == values.tolist() and unpacked(b"").tolist() == []


def test_heap_merge_equals_sums():
    rng = np.random.default_rng(3)
    n = 10_000  # several runs
    ids = np.sort(rng.integers(0, 5000, n))
    lists, total = [], np.zeros(n, np.int64)
    for _ in range(12):
        docs = np.flatnonzero(rng.random(n) < 0.001 + rng.random() ** 3)
        gain = rng.integers(1, 6, len(docs))
        total[docs] += gain
        lists.append((docs, gain, int(gain.max())))
    want = sorted(zip((-total).tolist(), ids.tolist()))[:25]
    best = []
    merge(lists, ids, best, 25)
    assert sorted((-s, -i) for s, i in best) == want
    low = -want[-1][0]
    best = []
    merge(lists, ids, best, 25, low)
    assert sorted((-s, -i) for s, i in best) == want
    best = []
    merge(lists, ids, best, 25, sum(x[2] for x in lists) + 1)
    assert best == []


@pytest.mark.parametrize("shard_bytes", [200, 1 << 24])
def test_contract_against_plain(spark, shard_bytes):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "TAIL", "x9"]
    text = lambda n: " ".join(words[min(62, int(x))] for x in rng.exponential(15, n))
    docs = [(int(k), text(int(n))) for k, n in zip(rng.permutation(400), rng.integers(0, 60, 400), strict=True)]
    docs += [(1000 + k, docs[0][1]) for k in range(120)]  # more copies than results
    docs += [(None, docs[0][1]), (None, None), (7, docs[0][1]), (7, docs[0][1]), (2000, ""), (2001, None), (2002, "... !!"), (2003, text(30_000)), (-5, docs[0][1])]
    items = [(k, text(12)) for k in range(25)] + [(3, docs[0][1]), (3, docs[0][1]), (None, "w1 W1 w2"), (30, None), (31, ""), (32, "nowhere"), (33, "?!"), (34, docs[0][1] + " tail" * 5)]
    table = spark.createDataFrame([(i, t, 1, 5) for i, t in docs], "doc_id long, text string, item_id int, score int").repartition(6)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    index = build_index(table, shard_bytes=shard_bytes)
    want = plain(docs, items)
    assert got(search(index, asked)) == want
    assert got(search(index, asked, pairs=40, first=2)) == want
    assert got(search(index, asked, k=3)) == plain(docs, items, 3)
    assert search(index, asked.limit(0)).count() == 0
    none = build_index(table.where("doc_id in (2000, 2001, 2002)"))
    assert none.count() == 0 and search(none, asked).count() == 0
    assert build_index(table.limit(0)).count() == 0


def test_given_tables_equal_sql(spark):
    d = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = duck.execute(f"SELECT item_id, rank, doc_id, score FROM ({OP13_SQL})").fetchall()
    assert len(want) > 1000 and got(op13_ranked_search(spark, d)) == sorted(want, key=repr)
