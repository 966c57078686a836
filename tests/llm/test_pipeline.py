import corpus_pipeline
from assaykit.llm.quality import quality_scores
from assaykit.llm.simhash import near_duplicates
from assaykit.llm.toxicity import toxicity_scores

DIR = "/root/testdata/sf0.01"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.kept(stage(spark, now, DIR), "test")
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in now.collect()}
            break
        assert out.columns == docs.columns
        ids = {r.doc_id for r in out.collect()}
        if name == "near_duplicates":
            want = {r.component_id for r in near_duplicates(now).collect()}
        else:
            scores, label = ((quality_scores, 1), (toxicity_scores, 0))[name == "toxicity"]
            want = {r.doc_id for r in scores(now, labels).collect() if r.predicted == label}
        assert ids == want and 0 < len(ids) < now.count()
        now = out
    assert corpus_pipeline.run(spark, DIR).count() == out.count()


def odd_tables(spark, folder):
    """Documents with nulls, empty and very long texts, ties, repeats and columns named like the operators' own; labels for most."""
    import random

    rng = random.Random(7)
    words = ["stone", "river", "cloud", "green", "walks", "slow", "field", "letter", "summer", "north"]
    rows = []
    for k in range(300):
        text = " ".join(rng.choices(words, k=80)) + f" number {k} of many"
        if k % 5 == 0:
            text = text.upper().replace(" ", "!! ")
        if k % 7 == 0:
            text = text.replace("river", "fool nasty", 1)
        rows.append((k, text))
    long = " ".join(f"{rng.choice(words)}{k % 977}" for k in range(400_000))
    rows += [(300, None), (301, ""), (302, " \n\t "), (None, None), (None, rows[1][1]), (303, long), (304, long), (3, rows[3][1]), (3, rows[3][1]), (3, "another text of that id " * 20)]
    docs = [(k, t, "en" if k is None or k % 2 else None, None if k == 8 else "web", len(t or ""), 1.5, "x", 7, "y") for k, t in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, _score string, fp long, component_id string"
    spark.createDataFrame(docs, names).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k % 5 != 0), int(k % 7 == 0)) for k in range(300)] + [(None, 1, 1), (4, 0, 0), (9, None, 5)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_odd_rows(spark, tmp_path):
    docs = odd_tables(spark, tmp_path)
    now, texts = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.kept(stage(spark, now, str(tmp_path)), "odd")
        assert out.columns == columns
        texts[name] = [(r.doc_id, r.text) for r in out.collect()]
        assert len(texts[name]) <= now.count() and set(texts[name]) <= {(d[0], d[1]) for d in docs}
        now = out
    good = [(d[0], d[1]) for d in docs if d[0] is not None and d[0] < 300 and d[0] % 5 and d[0] % 7 and d[0] not in (3, 4, 9)]
    assert set(good) <= set(texts["toxicity"])
    assert not {k for k, _ in texts["toxicity"] if k is not None and k < 300 and k % 7 == 0}
    last = texts["near_duplicates"]
    assert len(last) == len(set(last)) and sum(t == docs[3][1] for _, t in last) == 1
    assert sum(k in (303, 304) for k, _ in texts["toxicity"]) == 2 * sum(k in (303, 304) for k, _ in last)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in pieces if r.doc_id is not None}) == sorted({k for k, _ in last if k is not None})
    assert sum(r.length for r in pieces) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in pieces}.values())


def test_no_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DIR}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
