import numpy as np

from assaykit.llm.rules import CONDITIONS, Condition, apply_rules, covers, learn_quality_rules, learn_rules, verdict
from assaykit.llm.stats import COUNTS, NAMES


def planted(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    table = rng.random((n, len(NAMES)))
    i, j, k = (NAMES.index(x) for x in ("upper_share", "bar_share", "stop_share"))
    bad = ((table[:, i] > 0.8) & (table[:, j] > 0.5)) | (table[:, k] < 0.06)
    return table, bad


def test_planted_rules_are_found():
    table, bad = planted()
    rules = learn_rules(table, bad)
    other, truth = planted(seed=2)
    hit = np.zeros(len(other), bool)
    for r in rules:
        hit |= covers(r, other)
    assert (hit == truth).mean() > 0.97
    assert all(1 <= len(r) <= CONDITIONS for r in rules)
    assert learn_rules(table, bad) == rules


def test_nothing_to_learn():
    table, bad = planted(200)
    assert learn_rules(table, np.zeros(200, bool)) == learn_rules(table, ~np.zeros(200, bool)) == learn_rules(table[:0], bad[:0]) == []
    noise = np.random.default_rng(3).random(200) < 0.3
    assert len(learn_rules(table, noise)) <= 1


def test_order_and_expression(spark):
    rules = [(Condition("upper_share", True, 0.5), Condition("bar_share", False, 0.1)), (Condition("stop_share", False, 0.0),)]
    names = ["upper_share", "bar_share", "stop_share"]
    rows = [(0.6, 0.1, 0.3), (0.6, 0.2, 0.3), (0.5, 0.1, 0.0), (0.5, 0.1, 0.1)]
    got = spark.createDataFrame(rows, names).select(verdict(rules).alias("v")).collect()
    assert [r.v for r in got] == [False, True, False, True]
    assert spark.createDataFrame(rows, names).select(verdict([]).alias("v")).distinct().collect()[0].v is True


def test_query_over_texts(spark):
    good = [(k, " ".join(f"w{k}x{j}" for j in range(60 + k % 7)), "n") for k in range(300)]
    bad = [(300 + k, " ".join(f"W{k}X{j}!!" for j in range(60 + k % 5)), "n") for k in range(60)]
    odd = [(None, None, "n"), (900, "", None), (901, "a b c " * 40, "n"), (902, "one two", "n"), (3, good[3][1], "n")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 300)) for r in good + bad] + [(None, 0), (7, None)], "doc_id long, quality int")
    rules = learn_quality_rules(docs, labels)
    got = apply_rules(docs, rules).collect()
    assert len(got) == len(good + bad + odd) and rules
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.doc_id is not None and r.doc_id < 300)
    assert {x for x in COUNTS} <= set(got[0].asDict())
    assert apply_rules(docs.limit(0), rules).count() == 0
    assert learn_quality_rules(docs, labels.limit(0)) == []


def test_a_very_long_text_and_held_out_figures(spark):
    from assaykit.llm.common import remainder
    from assaykit.llm.rules import apply_rules, learn_quality_rules

    long = " ".join(f"w{k}" for k in range(700_000))
    got = apply_rules(spark.createDataFrame([(1, long), (2, "a b c " * 300_000)], "doc_id long, text string"), []).collect()
    assert {r.doc_id: (r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in got} == {1: (700_000, 0, False, True), 2: (900_000, 900_000, True, False)}
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = learn_quality_rules(docs, labels)
    rows = apply_rules(docs, rules).join(labels, "doc_id").where(remainder("doc_id", 5) == 0).select("kept", "quality").toPandas()
    good = rows.quality == 1
    assert rules and rows.kept[good].mean() > 0.9 and (~rows.kept[~good]).mean() > 0.95
