import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaykit.llm.common import remainder
from assaykit.llm.language import STRETCH, Model, automaton, learn, op11_cross_parse, plain_bytes, predict


def parsed(text: bytes, sample: bytes) -> int:
    """Phrases of a text, by search."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


def normal(text) -> bytes:
    return re.sub(rb" +", b" ", re.sub(rb"[^a-z\x80-\xff]", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())))


def test_bytes_of_texts():
    texts = ["Ab  c", "", None, "...x\x00y9 Ñandú!", "   ", "ÀÉ\n\n1z"]
    for some in (texts, texts[2:], [""], []):
        raw, ends = plain_bytes(pa.array(["drop", *some], pa.string()).slice(1))
        assert [raw[a:b].tobytes() for a, b in zip(ends, ends[1:])] == [normal(t) for t in some]


def test_phrases_equal_a_search():
    rng = np.random.default_rng(1)
    letters = "abcd eé"
    make = lambda n, k: "".join(letters[i] for i in rng.integers(0, k, n))
    samples = [normal(make(700, 5)) + b"\0" + normal(make(300, 5)), normal(make(400, 7)), b"aaaaaaaaab", b"z"]
    model = Model(list("abcd"), [len(s) for s in samples], [automaton(s) for s in samples])
    texts = ["", "x", "xx a", "aaaaaaaaaaaaaaaaaaaab", *(make(int(n), 7) + "Qx" * int(n % 3) for n in rng.integers(0, 300, 60)), make(5000, 6)]
    raw, ends = plain_bytes(pa.array(texts))
    for stretch in (7, STRETCH):
        want = [[sum(parsed(t[k : k + stretch], s) for k in range(0, len(t), stretch)) for s in samples] for t in map(normal, texts)]
        assert model.phrases(raw, ends, stretch).tolist() == want


def test_odd_rows_and_ties(spark):
    kind = "doc_id long, text string, lang string, source string, score double"
    en, fr = "the cat sat on the mat and the dog ran ", "le chat est sur la table et le chien court "
    rows = [(k, en * (1 + k % 3), "en", "s", 1.0) for k in range(12)] + [(20 + k, fr * (1 + k % 3), "fr", "s", 1.0) for k in range(12)]
    odd = [(50, None, "en", None, None), (51, "", "fr", "s", 0.0), (52, "12 ... !", "en", "s", 0.0), (None, "the cat", None, "s", 0.0), (53, en * 40_000, None, "s", 0.0), (54, "日本語", "fr", "s", 0.0), (0, en, "en", "s", 1.0)]
    docs = spark.createDataFrame(rows + odd, kind)
    model = learn(docs.where("doc_id <> 54 or doc_id is null"), F.lit(True))
    assert model.names == ["en", "fr"]
    got = predict(docs, model).collect()
    assert len(got) == len(rows + odd)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert all(by[i][0][0] == lang and 0.5 < by[i][0][1] <= 1 for i, _, lang, _, _ in rows)
    assert by[50] == by[51] == by[52] == [("und", 0.0)] and by[53][0][0] == by[None][0][0] == "en" and by[0][0] == by[0][1]
    assert by[54][0][0] in model.names and abs(by[54][0][1] - 0.5) < 0.1
    alone = predict(docs, learn(docs, F.col("lang") == "fr")).where("doc_id = 3").first()
    assert (alone.lang_pred, alone.score) == ("fr", 1.0)
    none = learn(docs, F.lit(False))
    assert none.names == [] and {(r.lang_pred, r.score) for r in predict(docs, none).collect()} == {("und", 0.0)}
    assert predict(docs.limit(0), model).count() == 0 and learn(docs.limit(0), F.lit(True)).names == []


def test_learning_reads_only_its_rows(spark):
    rows = [(k, f"{'ab' if k % 2 else 'xy'} " * 30, "p" if k % 2 else "q") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = remainder("doc_id", 4) == 2
    other = docs.withColumns({"lang": F.when(held, F.lit("held")).otherwise(F.col("lang")), "text": F.when(held, F.lit("zz")).otherwise(F.col("text"))})
    one, two = learn(docs, ~held), learn(other, ~held)
    assert one.names == two.names == ["p", "q"] and all((a == b).all() for x, y in zip(one.automata, two.automata) for a, b in zip(x, y))


@pytest.mark.parametrize("size", ["sf0.1"])
def test_held_out_accuracy(spark, size):
    d = f"/root/testdata/{size}"
    got = op11_cross_parse(spark, d)
    rows = got.join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").where("held_out and lang_pred <> 'und'").select("lang_pred", "lang", "n_chars").toPandas()
    assert got.count() == 10_000 and len(rows) > 2000
    right = rows.lang_pred == rows.lang
    print(right.mean(), rows[~right].head(20))
    assert right.mean() > 0.97
