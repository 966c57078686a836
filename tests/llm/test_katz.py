import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from assaykit.llm import katz
from assaykit.llm.katz import HELD, LARGE, discounts, learn, pack, score_other, score_texts, unpack


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


class Plain:
    """The same model over dictionaries, evaluated recursively."""

    def __init__(self, texts):
        self.one, self.two, self.starts = Counter(), Counter(), 0
        for t in texts:
            got = tokens(t)
            self.starts += 1
            self.one.update(got)
            self.two.update(zip(["<s>", *got], got, strict=False))
        self.n = sum(self.one.values())
        self.d1, self.d2 = (discounts(Counter(c.values())) for c in (self.one, self.two))
        self.unknown = 1 - math.fsum(self.kept(c, self.d1) for c in self.one.values()) / self.n if self.n else 1.0
        self.after = defaultdict(list)
        for h, w in self.two:
            self.after[h].append(w)

    @staticmethod
    def kept(c, d):
        return d[c - 1] * c if c <= LARGE else c - HELD

    def p1(self, w):
        return self.kept(self.one[w], self.d1) / self.n if w in self.one else self.unknown

    def p(self, w, h):
        times = self.starts if h == "<s>" else self.one[h]
        if not times:
            return self.p1(w)
        if (h, w) in self.two:
            return self.kept(self.two[h, w], self.d2) / times
        left = 1 - math.fsum(self.kept(self.two[h, x], self.d2) for x in self.after[h]) / times
        return left / (1 - math.fsum(self.p1(x) for x in self.after[h])) * self.p1(w)

    def score(self, text):
        got = tokens(text)
        return sum(math.log10(self.p(w, h)) for h, w in zip(["<s>", *got], got, strict=False))

    def base(self, text):
        return sum(math.log10((self.one[w] + 0.1) / (self.n + 0.1 * (len(self.one) + 1))) for w in tokens(text))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"W{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    rows = [(k, " ".join(rng.choices(words, weights, k=rng.randrange(0, 40)))) for k in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (None, "w1 w2 déjà"), (5, "again w1"), (5, "again w1"), (n + 3, "w1\tW2\x0bw3\x1cx  ")]
    return rows


@pytest.mark.parametrize("n", [0, 8, 400])
def test_against_the_plain_model(spark, tmp_path, n):
    rows = corpus(n, n)
    spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "TEXT0").selectExpr("doc_id", "TEXT0 as text", "1 as score", "2 as block").repartition(3).write.parquet(str(tmp_path / "d"))
    got = score_texts(spark.read.parquet(str(tmp_path / "d"))).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    model = Plain([t for i, t in rows if not held(i)])
    want = sorted(((-1 if i is None else i), held(i), len(tokens(t)), sum(w in model.one for w in tokens(t)), model.n, model.base(t), model.score(t)) for i, t in rows)
    found = sorted(((-1 if r.doc_id is None else r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [w[:5] for w in want] == [f[:5] for f in found]
    assert np.allclose([w[5:] for w in want], [f[5:] for f in found], rtol=1e-9, atol=1e-9)
    if n == 400:
        for h in ["<s>", "w0", "w299", "w17", "never"]:
            total = math.fsum(model.p(w, h) for w in model.one) + model.p("never", h)
            assert abs(total - 1) < 1e-9


def test_a_stored_model_scores_other_texts(spark, tmp_path):
    rows, others = corpus(1, 200), corpus(2, 60) + [(900, "never W1 seen W2 W2 W1"), (901, "W299 W298 W0")]
    of = lambda x: spark.createDataFrame([(a, b, 1) for a, b in x], "doc_id long, text string, score int").repartition(3)
    learn(of(rows)).write(f"{tmp_path}/model")
    got = score_other(of(others), katz.Model.read(spark, f"{tmp_path}/model")).collect()
    model = Plain([t for _, t in rows])
    want = sorted(((-1 if i is None else i), len(tokens(t)), sum(w in model.one for w in tokens(t)), model.base(t), model.score(t)) for i, t in others)
    found = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    assert np.allclose(np.array(want), np.array(found), rtol=1e-9, atol=1e-9)
    assert score_other(of(others).limit(0), learn(of(rows))).count() == 0
    assert [r.score for r in score_other(of(others[:3]), learn(of(rows).limit(0))).collect()] == [0.0] * 3


def test_many_parts_and_a_hot_pair(spark, tmp_path, monkeypatch):
    """A third of all pairs is one pair; parts and dictionary rows are small, and frequent histories are dealt by both words."""
    monkeypatch.setattr(katz, "PART_TOKENS", 640)
    monkeypatch.setattr(katz, "ROW_WORDS", 7)
    monkeypatch.setattr(katz, "GATHERED", 50)
    monkeypatch.setattr(katz, "BLOCK_BYTES", 500)
    rows = corpus(3, 150) + [(1000 + k, "and so " * 12 + f"w{k}") for k in range(120)] + [(2000, "so and w1 " * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    model = Plain([t for i, t in rows if not held(i)])
    found = {(r.doc_id, r.n_tokens): r.score for r in score_texts(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert all(abs(found[i, len(tokens(t))] - model.score(t)) < 1e-6 for i, t in rows)


def test_nothing_to_learn_from(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got] == [(True, 3, 0, 0, 0.0)]


def test_discounts():
    d = discounts({1: 1000, 2: 400, 3: 220, 4: 140, 5: 100, 6: 75})
    assert ((d > 0) & (d < 1)).all()
    taken = sum((1 - d[r - 1]) * r * n for r, n in {1: 1000, 2: 400, 3: 220, 4: 140, 5: 100}.items())
    assert abs(taken - 1000) < 1e-6  # Katz: what is taken is the mass of types seen once
    assert ((discounts({}) > 0) & (discounts({1: 3, 7: 2}) < 1)).all()


def test_packing():
    a = [np.array([0, 300, 2**40]), np.zeros(0, np.int64), np.array([0.5, -1e300]), np.array([1, 2, 255])]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(a, unpack(pack(*a)), strict=True))


def test_held_out_texts_are_scored_better_than_by_the_base(spark):
    """Of the given table: log10 probability of a token, in texts that the model hasn't seen."""
    rows = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").selectExpr("sum(score) / sum(n_tokens) AS score", "sum(base_score) / sum(n_tokens) AS base").first()
    assert math.isfinite(rows.score) and rows.score > rows.base + 0.5
