"""Quality rules: decision lists learned by sequential covering, as ordered Spark conditions.

Each rule is a conjunction of thresholds on a text's statistics that describes documents to reject.
It grows on two thirds of the rows, one condition at a time, by information gain; is pruned on the
other third to the length with the best precision there; and is kept if that precision is high
enough. Rows it covers are then set aside and the next rule is sought among the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import bound_batches, remainder, table, text_slices
from assaykit.llm.fm import SAMPLE, labelled_sample
from assaykit.llm.stats import COUNTS, NAMES, SHARES, statistics

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The form of the list, not of the data: most rules, most conditions of one, thresholds tried for each statistic, least precision and rows of a rule.
RULES, CONDITIONS, THRESHOLDS, PRECISION, SUPPORT = 12, 5, 40, 0.9, 4


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def holds(self, table: np.ndarray) -> np.ndarray:
        x = table[:, NAMES.index(self.name)]
        return x > self.value if self.above else x <= self.value

    def column(self) -> Column:
        return F.col(self.name) > F.lit(self.value) if self.above else F.col(self.name) <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, table: np.ndarray) -> np.ndarray:
    ok = np.ones(len(table), bool)
    for c in rule:
        ok &= c.holds(table)
    return ok


def _grow(table: np.ndarray, bad: np.ndarray, names: tuple[str, ...]) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(table), bool)
    while len(rule) < CONDITIONS and (~bad[inside]).any():
        t, y = table[inside], bad[inside]
        now = np.log2(y.mean())
        best, gain = None, 1e-9
        for name in names:
            x = t[:, NAMES.index(name)]
            cuts = np.unique(np.quantile(x, np.linspace(0, 1, THRESHOLDS + 2)[1:-1]))
            cuts = np.unique(np.concatenate([cuts, np.quantile(x[y], np.linspace(0, 1, 12))]))
            order = np.argsort(x, kind="stable")
            hits = np.concatenate([[0], np.cumsum(y[order])])
            at = np.searchsorted(x[order], cuts, side="right")
            for above in (False, True):
                n = len(x) - at if above else at
                p = hits[-1] - hits[at] if above else hits[at]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(p > 0, p * (np.log2(p / n) - now), -1)
                k = int(np.argmax(gains))
                if gains[k] > gain:
                    best, gain = Condition(name, above, float(cuts[k])), gains[k]
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(table)
    return tuple(rule)


def _precision(rule: Rule, table: np.ndarray, bad: np.ndarray) -> tuple[float, int]:
    inside = covers(rule, table)
    return (float((bad & inside).sum()) + 0.5) / (inside.sum() + 1), int((bad & inside).sum())


def _prune(rule: Rule, table: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best (p - n) / (p + n), the shorter of equals."""
    worth = []
    for k in range(1, len(rule) + 1):
        inside = covers(rule[:k], table)
        p = (bad & inside).sum()
        worth.append((2 * p - inside.sum()) / max(1, inside.sum()))
    return rule[: 1 + int(np.argmax(worth))]


def learn_rules(table: np.ndarray, bad: np.ndarray, names: tuple[str, ...] = NAMES, seed: int = 5) -> list[Rule]:
    """Rules that reject, in order; none where no rule is precise enough, or one label is missing."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(table), bool)
    grow = rng.random(len(table)) < 2 / 3
    while len(rules) < RULES:
        a, b = left & grow, left & ~grow
        if not (bad & a).any() or not (~bad & a).any() or not (bad & b).any():
            break
        rule = _prune(_grow(table[a], bad[a], names), table[b], bad[b])
        if not rule:
            break
        precision, hits = _precision(rule, table[left], bad[left])
        if precision < PRECISION or hits < SUPPORT or _precision(rule, table[b], bad[b])[0] < PRECISION - 0.1:
            break
        rules.append(rule)
        left &= ~covers(rule, table)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression: the first rule that holds rejects."""
    out = F
    for rule in rules:
        held = rule[0].column()
        for c in rule[1:]:
            held = held & c.column()
        out = out.when(held, F.lit(False))
    return F.lit(True) if out is F else out.otherwise(F.lit(True))


def text_statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """carried columns and NAMES, one double each, for every row.

    A null or empty text has zeros throughout; a very long one is counted whole. Repeated rows are counted
    each. Columns that aren't carried are left out. No rows give no rows.
    """
    bound_batches(docs.sparkSession)
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches):
        for batch in batches:
            for lo, hi in text_slices(batch, 0):
                part = batch.slice(lo, hi - lo)
                got = statistics(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *map(pa.array, got.T)], names=[*carried, *NAMES])

    return docs.select("text", *carried).mapInArrow(run, f"{kinds}, " + ", ".join(f"{n} double" for n in NAMES))


def learn_quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most about `sample` documents with a quality label outside fold 0 of 5.

    Which they are, and what of repeated or null ids: labelled_sample. Without usable labels, or with
    one label alone, there are no rules, and all texts that pass the base are kept.
    """
    rows = text_statistics(labelled_sample(docs, labels, "quality", sample=sample), "doc_id", "y").toArrow().sort_by("doc_id")
    found = np.column_stack([rows.column(n).to_numpy() for n in NAMES])
    return learn_rules(found, rows.column("y").to_numpy() == 0, SHARES)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the five counts, the shares, base_failed and kept for every row.

    base_failed: under MIN_WORDS words, or over MAX_REPEAT_PERCENT of them in repeated 3-word windows.
    kept: false if base_failed, else what the rules say. A null or empty text fails. Repeated rows
    are judged each. Columns other than doc_id and text are left out. No rows give no rows.
    """
    found = text_statistics(docs, "doc_id")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules))
    judged = found.withColumn("base_failed", failed).withColumn("kept", kept)
    return judged.select("doc_id", *(F.col(c).cast("long").alias(c) for c in COUNTS), *SHARES, "base_failed", "kept")


def op5_rules(spark, sf_dir: str) -> DataFrame:
    """Every row of documents, by rules learned from labels; see apply_rules."""
    docs = table(spark, sf_dir, "documents")
    got = apply_rules(docs, learn_quality_rules(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", *COUNTS, "base_failed", "kept", (remainder("doc_id", 5) == 0).alias("held_out"))
