"""Checks of labelled rows: problems of each row, repeated ids, dangling pointers, next id, derivations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit import labels as L
from assaykit.functions.regex import found, rx
from assaykit.functions.text import out_of_scope_term
from assaykit.shared import checkpointed, fresh

ID = r"^gst-(?:\d{4}|[1-9]\d{4,})$"  # four digits, more where these don't do


def is_active(df: DataFrame) -> DataFrame:
    return df.where(F.col("deprecated_by").isNull())


def reason_code(notes: Column) -> Column:
    return found(notes, r"reason=([a-z-]+)", 1)


def _blank(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(rx(r"^\s*$"))


def problems(quarantine: bool = False) -> Column:
    """Codes of a row's problems, in the order of the rules.

    Columns read: labelled_by, id, input, label, answerable, labeller_notes, difficulty, heading,
    source, justification. In quarantine an UNCERTAIN row is checked by the first four rules only.
    """
    c = F.col
    label, answerable = F.coalesce(c("label"), F.lit("")), F.coalesce(c("answerable"), F.lit(False))
    reason, term = reason_code(c("labeller_notes")), out_of_scope_term(F.coalesce(c("input"), F.lit("")))

    def rule(code: str, broken: Column) -> Column:
        return F.when(broken, F.lit(code))

    known_by = F.coalesce(c("labelled_by").isin(*L.LABELLERS), F.lit(False))
    label_problem = (
        F.when(label.isin(*L.RETIRED), "label_retired")
        .when((label == L.UNCERTAIN) & F.lit(not quarantine), "label_uncertain")
        .when(~label.isin(*L.VALID, L.UNANSWERABLE, L.UNCERTAIN), "label_unknown")
    )
    by = F.when(~known_by, "labeller_unknown").when(F.lit(not quarantine) & c("labelled_by").isin(*L.QUARANTINED), "labeller_unreviewed")
    first = [by, rule("id_form", ~F.coalesce(c("id").rlike(ID), F.lit(False))), rule("input_empty", _blank(c("input"))), label_problem]
    rest = [
        rule("answerable_but_unanswerable", answerable & (label == L.UNANSWERABLE)),
        rule("unanswerable_but_label", ~answerable & (label != L.UNANSWERABLE)),
        F.when(~answerable & reason.isNull(), "reason_missing").when(~answerable & ~reason.isin(*L.REASONS), "reason_unknown"),
        rule("unanswerable_difficulty", ~answerable & ~F.coalesce(c("difficulty").isin("out_of_scope", "hard"), F.lit(False))),
        rule("heading_form", c("heading").isNotNull() & ~c("heading").rlike(r"^\d{4}$")),
        rule("heading_missing", answerable & c("heading").isNull()),
        rule("difficulty_unknown", ~F.coalesce(c("difficulty").isin(*L.TARGETS), F.lit(False))),
        rule("source_unknown", (F.coalesce(c("source"), F.lit("")) != "") & ~c("source").isin(*L.SOURCES)),
        rule("justification_empty", _blank(c("justification"))),
        rule("out_of_scope", term.isNotNull()),
    ]
    whole = F.array_compact(F.array(*first, *rest))
    if not quarantine:
        return whole
    return F.when(label == L.UNCERTAIN, F.array_compact(F.array(*first))).otherwise(whole)


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(df: DataFrame, key: str = "id", pointer: str = "deprecated_by") -> DataFrame:
    """Rows whose pointer names no row."""
    ids = df.select(F.col(key).alias("_target")).distinct()
    return df.where(F.col(pointer).isNotNull()).join(ids, F.col(pointer) == F.col("_target"), "left_anti").select(key, pointer)


def next_id(df: DataFrame, key: str = "id") -> DataFrame:
    """One row: the greatest well-formed id's successor, gst-0001 without any."""
    n = F.when(F.col(key).rlike(ID), F.substring(key, 5, 18).cast("long"))
    return df.agg(F.format_string("gst-%04d", F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_id"))


def all_ids(*tables: DataFrame, key: str = "id") -> DataFrame:
    """The ids of all tables, repeats included: what next_id and unlabelled go by when rows wait in several places."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.unionByName(t.select(key))
    return out


def verify_documents(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Per document of a manifest (file, bytes, sha256, must_contain): what is wrong with its file (file, length, sha256, text)."""
    f = files.select(F.col("file").alias("_file"), F.col("length").alias("_len"), F.col("sha256").alias("_sha"), "text")
    df = documents.join(f, F.col("file") == F.col("_file"), "left")
    miss = F.filter(F.coalesce("must_contain", F.array().cast("array<string>")), lambda s: ~F.contains(F.coalesce("text", F.lit("")), s))
    return df.select(
        "file",
        F.col("_file").isNull().alias("missing"),
        F.coalesce(F.col("bytes") != F.col("_len"), F.lit(False)).alias("wrong_size"),
        F.coalesce(F.lower("sha256") != F.lower("_sha"), F.lit(False)).alias("wrong_hash"),
        F.when(F.col("_file").isNull(), 0).otherwise(F.size(miss)).alias("passages_missing"),
    )


def correction_chains(df: DataFrame, key: str = "id", pointer: str = "deprecated_by") -> DataFrame:
    """(key, state, final, depth) of each id: where its corrections end, and after how many.

    state: active (final is the id itself), replaced (final is active), dangling (final's pointer names no row),
    cycle (no final and no depth). An id in several rows counts once, with its smallest pointer; null ids are left
    out. Pointers double in each round, so a chain of n corrections takes about log2(n) rounds; a round
    that settles nothing leaves only cycles, and rows that lead into them.
    """
    k, p, end, steps, more, further = (fresh(df, x) for x in ("_key", "_pointer", "_end", "_steps", "_more", "_further"))
    rows = checkpointed(df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(k)).agg(F.min(pointer).alias(p)))
    there = rows.select(F.col(k).alias(end), F.lit(True).alias(more))
    linked = rows.join(there, F.col(p) == F.col(end), "left").select(k, p, F.coalesce(more, F.lit(False)).alias(more))
    ends = linked.where(~F.col(more)).select(F.col(k).alias(end), F.when(F.col(p).isNull(), "active").otherwise("dangling").alias("state"))
    now = checkpointed(linked.where(more).select(k, F.col(p).alias(end), F.lit(1).cast("long").alias(steps)))
    open_, last = now.count(), -1
    while open_ and open_ != last:
        jumps = now.select(F.col(k).alias(p), F.col(end).alias(further), F.col(steps).alias(more))
        now = now.join(jumps, F.col(end) == F.col(p), "left").select(k, F.coalesce(further, end).alias(end), (F.col(steps) + F.coalesce(more, F.lit(0))).alias(steps), F.col(p).isNotNull().alias(more))
        now = checkpointed(now)
        last, open_ = open_, now.where(more).count()
        now = now.select(k, end, steps)
    settled = now.join(ends, end, "left")  # a row whose end isn't one goes round
    long = settled.select(F.col(k).alias(key), F.when(F.col("state").isNull(), "cycle").when(F.col("state") == "active", "replaced").otherwise("dangling").alias("state"), F.when(F.col("state").isNotNull(), F.col(end)).alias("final"), F.when(F.col("state").isNotNull(), F.col(steps)).alias("depth"))
    return ends.select(F.col(end).alias(key), "state", F.col(end).alias("final"), F.lit(0).cast("long").alias("depth")).unionByName(long)
