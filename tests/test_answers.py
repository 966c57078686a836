import pytest
from pyspark.sql import functions as F

from assaykit.functions import answers as A
from assaykit.operators import evaluation


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,label,heading,answerable,unparseable",
    [
        ("SLAB: 18\nHSN: 3307\nANSWERABLE: yes\nWHY: it is", "18", "3307", True, False),
        ("  slab - 5.0 %\nhsn: 1905 90", "5", "1905", True, False),
        ("SLAB: 18.00", "18.00", None, True, False),
        ("SLAB: cannot say\nHSN: none", "UNANSWERABLE", None, False, False),
        ("SLAB: 12%\nANSWERABLE: no", "12", None, False, False),
        ("SLAB:\nHSN: 9608", "9608", "9608", True, False),
        ("SLAB: about", None, None, None, False),
        ("it is 18%", None, None, None, True),
        ("", None, None, None, True),
        (None, None, None, None, True),
        ("SLAB: 5\nHSN: N/A", "5", None, True, False),
    ],
)
def test_parse(spark, text, label, heading, answerable, unparseable):
    p = one(spark, A.parse_answer(F.lit(text).cast("string")))
    assert (p.label, p.heading, p.answerable, p.unparseable) == (label, heading, answerable, unparseable)


def test_why_is_squeezed(spark):
    assert one(spark, A.parse_answer(F.lit("SLAB: 5\nWHY:  a \t b\n"))).why == "a b"


@pytest.mark.parametrize(
    "text,cited",
    [
        ("it attracts 12% now", ["12"]),
        ("28 per cent, and 12 percent; again 28%", ["28", "12"]),
        ("12 perceent", []),
        ("it was 12% earlier", []),
        ("omitted: 28%", []),
        ("rates of 112% and 1.12% and 12.5%", []),
        ("heading 1228, at 18%", []),
        ("now 28%." + " x" * 80 + " it was so", ["28"]),
        ("was" + " x" * 80 + " 12%", ["12"]),
        ("", []),
        (None, []),
    ],
)
def test_citations(spark, text, cited):
    assert one(spark, A.retired_citations(F.lit(text).cast("string"))) == cited


def rows(spark):
    data = [
        (1, "18", "3307", False, "SLAB: 18\nHSN: 3307"),
        (2, "18", "3307", False, "SLAB: 12\nHSN: 3399"),
        (3, "5", "1905", False, "SLAB: 28\nHSN: 1000"),
        (4, "5", "1905", False, "SLAB: 3\nHSN: 1905\nWHY: 28%"),
    ]
    return spark.createDataFrame(data, "id int, gold string, gold_heading string, errored boolean, text string")


def test_summary_example(spark):
    s = evaluation.summarise(evaluation.score_responses(rows(spark))).first()
    assert (s.n, s.label_acc, s.retired_rate, s.retired_cited_rate, s.heading_acc, s.chapter_acc) == (4, 0.25, 0.5, 0.75, 0.5, 0.75)


def test_abstention(spark):
    data = [("UNANSWERABLE", "SLAB: UNANSWERABLE"), ("UNANSWERABLE", "SLAB: 5"), ("5", "SLAB: UNANSWERABLE"), ("5", "SLAB: 5")]
    df = spark.createDataFrame([(g, "1905", False, t) for g, t in data], "gold string, gold_heading string, errored boolean, text string")
    s = evaluation.summarise(evaluation.score_responses(df)).first()
    assert (s.abstain_precision, s.abstain_recall, s.abstain_f1) == (0.5, 0.5, 0.5)
    void = df.withColumn("errored", F.lit(True))
    v = evaluation.summarise(evaluation.score_responses(void)).first()
    assert (v.label_acc, v.heading_acc, v.errored, v.abstain_recall, v.n_graded) == (0.0, 0.0, 4, 0.0, 0)
    assert evaluation.summarise(evaluation.score_responses(df.limit(0))).first().label_acc == 0.0


def test_describe(spark):
    counts = evaluation.retired_counts(evaluation.score_responses(rows(spark))).withColumn("n", F.lit(4))
    assert evaluation.describe_retired(counts, F.col("n")).first().line == "50.0% — 12% (abolished 2025-09-22) ×1, 28% (abolished 2026-02-01) ×1"


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 1, 4, 2, 3, 0)] + [("b", 0), ("b", None)], "k string, v int")
    got = {r.k: (r.p50, r.p95) for r in df.groupBy("k").agg(evaluation.nearest_rank(F.col("v"), 50).alias("p50"), evaluation.nearest_rank(F.col("v"), 95).alias("p95")).collect()}
    assert got == {"a": (2, 5), "b": (0, 0)}
    assert [tuple(r) for r in evaluation.nearest_rank_by(df, ["k"], "v", 50, 95).collect()] == [("a", 2, 5)]


def test_rank(spark):
    runs = spark.createDataFrame([("x", None, 0.9), ("y", 2.0, 0.5), ("z", 1.0, 0.1), ("w", None, 0.95), ("v", 2.0, 0.6)], "model_key string, inr_per_correct double, label_acc double")
    assert [r.model_key for r in evaluation.rank_runs(runs).orderBy("rank").collect()] == ["z", "v", "y", "w", "x"]


@pytest.mark.parametrize("text,label", [("VERDICT: PASS\nREASON: a  b", "PASS"), ("verdict - not a pass, FAIL", "FAIL"), ("VERDICT: maybe", "UNPARSEABLE"), ("PASS", "UNPARSEABLE"), (None, "UNPARSEABLE")])
def test_verdicts(spark, text, label):
    assert one(spark, A.parse_verdict(F.lit(text).cast("string"))).label == label


def test_judge_prompt_and_money(spark):
    p = one(spark, A.judge_prompt("{gold_hsn}|{gold_slab}|{description}|{justification}", F.lit(" d " + "x" * 3000), F.lit(None).cast("string"), F.lit("5"), F.lit("")))
    assert p.startswith("(none established)|5|d xx") and len(p.split("|")[2]) == 2000 and p.endswith("(the model gave no explanation)")
    assert [one(spark, A.money(F.lit(x).cast("double"), "$")) for x in (None, 0.5, 1234.5)] == ["—", "$0.5000", "$1,234.50"]
    assert one(spark, A.percent(F.lit(0.1234))) == "12.3%"
