import random

import numpy as np
import pyarrow as pa

from assaykit.llm.fm import Machine, _edge, fit, labelled_sample, learn, score, term_hashes
from assaykit.llm.quality import keep_quality, quality_scores
from assaykit.llm.stats import NAMES, repeated_windows, statistics
from assaykit.llm.toxicity import drop_toxic, toxicity_scores


def test_scores_are_the_sum_of_all_pairs():
    rng = np.random.default_rng(1)
    m = Machine(np.arange(9), None, 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    ids, owner = np.array([1, 4, 6, 0, 8]), np.array([0, 0, 0, 2, 2])
    got = m.scores(ids, owner, 3)
    for k in range(3):
        own = ids[owner == k]
        x = 0.3 + m.linear[own].sum() + sum(m.factors[i] @ m.factors[j] for i in own for j in own if i < j)
        assert abs(got[k] - 1 / (1 + np.exp(-x))) < 1e-12


def test_pairs_are_learned_where_lines_fail():
    rng = np.random.default_rng(2)
    rows = [(k, rng.integers(0, 2, 2)) for k in range(800)]
    owner = np.array([k for k, x in rows for _ in range(int(x.sum()) + 1)])
    hashes = np.array([h for _, x in rows for h in [7] + [10 + j for j in range(2) if x[j]]])
    y = np.array([int(x[0] and x[1]) for _, x in rows])
    m = fit(y, owner, hashes, None)
    both, one = m.scores(np.searchsorted(m.terms, [10, 11]), np.array([0, 0]), 1)[0], m.scores(np.searchsorted(m.terms, [10]), np.array([0]), 1)[0]
    assert both > 0.9 and one < 0.1


def test_an_exclusive_or_is_learned(spark):
    cases = {0: "the river runs", 1: "the alpha river runs", 2: "the river beta runs", 3: "the alpha river beta runs"}
    docs = spark.createDataFrame([(k, cases[k % 4]) for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 in (1, 2))) for k in range(600)], "doc_id long, toxic int")
    got = toxicity_scores(docs, labels).collect()
    assert len(got) == 600 and all(r.predicted == int(r.doc_id % 4 in (1, 2)) for r in got)
    alone = toxicity_scores(docs, labels, support=10_000).collect()  # no terms at all
    assert len({r.score for r in alone}) == 1


def test_the_sample_at_any_number_of_labels():
    for n in (1, 12_000, 50_000, 10**10, 10**14):
        assert abs((_edge(12_000, n) + (1 << 63)) / (1 << 64) * n - min(n, 12_000)) < 1


def test_statistics_against_loops():
    rng = random.Random(3)
    texts = [None, "", " \n ", "A b a b A b a", "x\nx\n\ny x\n x", "#|# é\tÉ\x0b!", *(" ".join(rng.choices("abc", k=rng.randrange(40))) + "\nab" * rng.randrange(3) for _ in range(50))]
    got = statistics(pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        words = (t or "").encode().split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert row[: len(NAMES[:5])].tolist() == [len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)]
    assert statistics(pa.array([], pa.string())).shape == (0, len(NAMES))
    big = np.array([2**40, 5, 6, 2**40, 5, 6])
    assert repeated_windows(big % 7, np.array([0, 6])).tolist() == [6]


def test_words_of_slices():
    from assaykit.llm.common import coded_words

    texts = pa.array([f" Déjà{k}  vu\x1cÅ\u0085…\n" + "ñ" * (k % 5) for k in range(50)] + [None, ""])
    for lo in (0, 1, 17, 49):
        part = texts.slice(lo, 3)
        for lower in (False, True):
            codes, ends, distinct = coded_words(part, lower)
            got = [[distinct[i].as_py() for i in codes[a:b].tolist()] for a, b in zip(ends, ends[1:], strict=False)]
            assert got == [[w.decode() for w in (t or "").encode().split()] if not lower else [w.decode() for w in (t or "").encode().lower().split()] for t in part.to_pylist()]


def test_terms():
    owner, hashes = term_hashes(pa.array(["The, the (THE) x", None, ""]))
    assert owner.tolist() == [0, 0] and len(set(hashes.tolist())) == 2


def tables(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        words = rng.choices(["stone", "river", "cloud", "green", "walks", "slow"], k=60)
        if toxic:
            words[rng.randrange(60)] = "fool,"
            words[rng.randrange(60)] = "nasty"
        text = " ".join(words)
        rows.append((k, (text.upper().replace(" ", "!! ") if bad else text), "x"))
        labels.append((k, int(not bad), int(toxic)))
    rows += [(None, None, "x"), (n, "", "x"), (n + 1, "  ", None), (3, rows[3][1], "y"), (3, rows[3][1], "y")]
    labels += [(None, 1, 1), (5, 1 - labels[5][1], 0), (n, None, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_models(spark):
    docs, labels = tables(spark)
    truth = {r.doc_id: r for r in labels.collect() if r.doc_id is not None and r.doc_id < 400 and r.doc_id != 5}
    for scores, column, keep, label in ((quality_scores, "quality", keep_quality, 1), (toxicity_scores, "toxic", drop_toxic, 0)):
        got = scores(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        right = [r.predicted == truth[r.doc_id][column] for r in got if r.doc_id in truth]
        assert np.mean(right) > 0.97
        assert len({r.score for r in got if r.doc_id in (None, 400)}) == 1
        docs = docs.withColumnRenamed("score", "_score")
        kept = keep(docs, labels)
        assert kept.columns == docs.columns
        assert kept.count() == sum(r.predicted == label for r in got)


def test_without_labels_or_rows(spark):
    docs, labels = tables(spark, 20)
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert len({round(r.score, 9) for r in toxicity_scores(docs, labels.where("toxic = 0")).collect()}) == 1
    assert toxicity_scores(docs.limit(0), labels).count() == 0
    assert labelled_sample(docs, labels, "quality").where("doc_id is null or doc_id = 5").count() == 0
    m = learn(docs, labels, "quality", True)
    assert score(docs.limit(0), m, 0.5).count() == 0


def test_very_long_texts_and_metadata(spark):
    docs, labels = tables(spark)
    long = "stone river " * 400_000
    docs = docs.unionByName(spark.createDataFrame([(5000, long, "x"), (5001, long + " nasty fool", "x")], "doc_id long, text string, score string"))
    got = {r.doc_id: r.predicted for r in toxicity_scores(docs, labels).where("doc_id >= 5000").collect()}
    assert got == {5000: 0, 5001: 1}
    plain = {(r.doc_id, r.score) for r in quality_scores(docs, labels).collect()}
    assert len(quality_scores(docs, labels).where("doc_id >= 5000 and score between 0 and 1").collect()) == 2
    from pyspark.sql import functions as F

    # n_chars that tells the label alone, with nulls: texts are all alike
    rows = [(k, "same words here for all", 100 + 900 * (k % 2) if k % 11 else None) for k in range(400)]
    told = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    marks = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int")
    right = quality_scores(told, marks).where("doc_id % 11 <> 0").select((F.col("predicted") == F.col("doc_id") % 2).alias("x")).collect()
    assert np.mean([r.x for r in right]) > 0.99
    assert len({r.score for r in quality_scores(told.drop("n_chars"), marks).collect()}) == 1 and plain


def test_held_out_figures(spark):
    """Documents whose labels no model has seen, of the given tables: quality, toxicity."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    from assaykit.llm.common import remainder

    for scores, column, least in ((quality_scores, "quality", 0.99), (toxicity_scores, "toxic", 0.94)):
        rows = scores(docs, labels).join(labels, "doc_id").where(remainder("doc_id", 5) == 0).select("score", column).toPandas()
        y, order = rows[column].to_numpy(), rows.score.rank().to_numpy()
        n = int(y.sum())
        auc = (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))
        assert auc > least
