"""Two raters: kappa, confusion, gates; one item over repeated runs: spread, stability, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit import labels as L
from assaykit.shared import fresh


def confusion(pairs: DataFrame, a: str = "a", b: str = "b", most: int = 1000) -> DataFrame:
    """(a, b, n) over all pairs of the union of labels, zeros included. More than `most` labels aren't a closed domain, and raise."""
    n = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    labels = n.select(F.explode(F.array("a", "b")).alias("x")).distinct()
    if labels.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} labels: a matrix of all pairs is for closed domains")
    grid = labels.select(F.col("x").alias("a")).crossJoin(F.broadcast(labels.select(F.col("x").alias("b"))))  # at most `most` rows
    return grid.join(n, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def reading(kappa: Column) -> Column:
    (first, text), *rest = L.KAPPA_BANDS
    out = F.when(kappa < first, text)
    for bound, text in rest:
        out = out.otherwise(F.lit(text)) if bound is None else out.when(kappa < bound, text)
    return out


def cohen_kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: n, observed, expected, kappa, reading, usable. Chance agreement of 1 makes kappa 1; no pairs make no row."""
    n = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    none = F.lit(0).cast("long")
    first = F.struct(F.col("a").alias("x"), F.col("n").alias("na"), none.alias("nb"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(none).alias("same"))
    second = F.struct(F.col("b").alias("x"), none.alias("na"), F.col("n").alias("nb"), none.alias("same"))
    each = n.select(F.inline(F.array(first, second))).groupBy("x").agg(*(F.sum(c).alias(c) for c in ("na", "nb", "same")))  # both marginals of a label
    df = each.agg(F.sum("na").alias("n"), F.sum("same").alias("same"), F.sum(F.col("na") * F.col("nb")).alias("both")).where("n > 0")
    po, pe = F.col("same") / F.col("n"), F.col("both") / (F.col("n") * F.col("n"))
    df = df.select("n", po.alias("observed"), pe.alias("expected"))
    kappa = F.when(F.col("expected") >= 1, F.lit(1.0)).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    df = df.withColumn("kappa", kappa)
    return df.withColumns({"reading": reading(F.col("kappa")), "usable": F.col("kappa") >= L.KAPPA_FLOOR})


def judged_pairs(verdicts: DataFrame, human: DataFrame, pos: str = "pos") -> DataFrame:
    """Verdicts with a human label, the last one where there are several; both in upper case."""
    own = fresh(verdicts, "_human")
    last = human.groupBy("example_id").agg(F.max_by("verdict", pos).alias(own))
    return verdicts.join(last, "example_id").select("example_id", F.upper(own).alias("human"), F.upper("verdict").alias("judge"))


def directions(pairs: DataFrame) -> DataFrame:
    """How often the judge was lenient (passed what the human failed) and how often strict."""
    return pairs.agg(F.count_if((F.col("human") == "FAIL") & (F.col("judge") == "PASS")).alias("lenient"), F.count_if((F.col("human") == "PASS") & (F.col("judge") == "FAIL")).alias("strict"))


def relabelled(gold: DataFrame, redo: DataFrame, key: str = "id") -> DataFrame:
    """Active gold rows and their second labels; a null heading counts as '-'."""
    g = gold.where(F.col("deprecated_by").isNull()).select(key, *(F.col(c).alias(f"gold_{c}") for c in ("label", "answerable", "heading")))
    return redo.join(g, key).withColumns({"heading": F.coalesce("heading", F.lit("-")), "gold_heading": F.coalesce("gold_heading", F.lit("-"))})


def agreement_gate(pairs: DataFrame, a: str, b: str, floor: float = L.AGREEMENT_FLOOR) -> DataFrame:
    same = F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double"))
    return pairs.agg(same.alias("agreement"), (same >= floor).alias("passed"))


def repeat_spread(summaries: DataFrame, run: str, metrics: list[str], places: int = 4) -> DataFrame:
    """For each metric: mean, min, max, range and the runs' values in order, all of rounded values.

    The mean is taken of whole units of the last place, so the order of its sum can't turn a tie.
    """
    unit = 10**places
    long = summaries.select(run, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.round(m, places).alias("v")) for m in metrics))).alias("x")).select(run, "x.metric", "x.v")
    values = F.transform(F.array_sort(F.collect_list(F.struct(run, "v"))), lambda s: s["v"])
    return long.groupBy("metric").agg((F.bround(F.sum(F.round(F.col("v") * unit).cast("long")) / F.count("v")) / unit).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.max("v") - F.min("v"), places).alias("range"), values.alias("runs"))


def stability(answers: DataFrame, item: str = "item", run: str = "run", answer: str = "answer") -> DataFrame:
    """Share of items that every run answers alike; no answer is an answer of its own."""
    per = answers.groupBy(item).agg(F.count_distinct(F.coalesce(answer, F.lit("None"))).alias("k"))
    return per.agg(F.count("*").alias("items"), F.count_if(F.col("k") == 1).alias("stable"), F.coalesce(F.avg((F.col("k") == 1).cast("double")), F.lit(0.0)).alias("rate"))


def majority_vote(answers: DataFrame, item: str = "item", run: str = "run", answer: str = "answer") -> DataFrame:
    """Each item's most frequent answer; of equals the one given first."""
    votes = answers.groupBy(item, F.coalesce(answer, F.lit("None")).alias("vote")).agg(F.count("*").alias("n"), F.min(run).alias("_first"))
    w = Window.partitionBy(item).orderBy(F.desc("n"), "_first")
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(item, "vote", "n")


def vote_accuracy(answers: DataFrame, gold: DataFrame, item: str = "item", run: str = "run", answer: str = "answer", label: str = "gold", places: int = 4) -> DataFrame:
    """One row: items, correct and accuracy of the majority votes. gold (item, label): one row an item; items without gold count as wrong."""
    votes = majority_vote(answers, item, run, answer).join(gold.select(item, F.col(label).alias("_gold")), item, "left")
    right = F.count_if(F.coalesce(F.col("vote") == F.col("_gold"), F.lit(False)))
    share = F.coalesce(F.bround(F.try_divide(right.cast("double"), F.count("*").cast("double")), places), F.lit(0.0))
    return votes.agg(F.count("*").alias("items"), right.alias("correct"), share.alias("accuracy"))


def unstable_items(answers: DataFrame, gold: DataFrame, item: str = "item", run: str = "run", answer: str = "answer", label: str = "gold") -> DataFrame:
    """(item, gold, answers) of items with different answers: all of an item's answers in the order of runs, null where there was none."""
    said = F.transform(F.array_sort(F.collect_list(F.struct(F.col(run).alias("r"), F.col(answer).alias("a")))), lambda x: x["a"])
    many = F.count_distinct(F.coalesce(answer, F.lit("None")))
    own = answers.groupBy(item).agg(said.alias("answers"), many.alias("_k")).where("_k > 1")
    return own.join(gold.select(item, F.col(label).alias("gold")), item, "left").select(item, "gold", "answers")


def aggregate_runs(summaries: DataFrame, answers: DataFrame, gold: DataFrame, metrics: list[str], run: str = "run") -> DataFrame:
    """One row for a probe of repeated runs: runs, metrics, self_agreement (with its unstable items) and majority_vote_acc.

    summaries: a row for each run; answers (item, run, answer); gold (item, gold). The unstable items
    come in one array: a probe's document is for sets that one can read.
    """
    spread = repeat_spread(summaries, run, metrics)
    named = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct("mean", "min", "max", "range", "runs")))))
    detail = F.array_sort(F.collect_list(F.struct("item", "gold", "answers"))).alias("detail")
    agreed = stability(answers).select(F.col("items").alias("examples"), F.col("stable").alias("answered_identically_every_run"), (F.col("items") - F.col("stable")).alias("unstable"), F.bround("rate", 4).alias("rate"))
    parts = [
        summaries.agg(F.count("*").alias("runs")),
        spread.agg(named.alias("metrics")),
        agreed.crossJoin(unstable_items(answers, gold).agg(detail)).select(F.struct("*").alias("self_agreement")),
        vote_accuracy(answers, gold).select(F.col("accuracy").alias("majority_vote_acc")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out
