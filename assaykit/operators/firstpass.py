"""First-pass rows: what a decision text and the schedules settle, and what they leave open. All of it awaits a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit import labels as L
from assaykit.functions.rulings import operative_ruling, outcome
from assaykit.functions.text import difficulty, goods_excerpt, is_scanned, is_withdrawn, normalise
from assaykit.operators import lookup, validation
from assaykit.operators.ordering import placed
from assaykit.shared import filtered_here, fresh

# --- fixed values: marks of a first-pass row
CHANGED_TAG, FIRST_PASS = "rate-changed-2025", "model-first-pass"
QUOTE, BASIS = 400, 300  # characters of a quote, and of a basis in a derived row's notes
# ------------------------------------------------------------------------------------------------------


def _told(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _moved(held: Column, schedule: Column) -> Column:
    where = F.when(schedule.isNotNull(), _told(" (schedule ", schedule, ")")).otherwise(F.lit(""))
    open_ = F.lit("not known: the decision states neither schedule nor rate")
    return F.when(held.isNull(), open_).when(held == "12", _told("held at 12%", where, ", a rate that is gone")).otherwise(_told("held at ", held, "%", where, ", not 12%; whether it moved is open"))


def suggest(pool: DataFrame, notice: DataFrame, exempt: DataFrame, at: Column, first_id: int = 1, text: str = "ruling_text", pos: str = "pos", quarantine: bool = True) -> DataFrame:
    """One suggestion for each pool row (source, source_id, input, collected_at, text, pos), as an example row.

    The heading is the first one of the text's operative passage, the label what the schedules of the
    notice (text) and the exempt list (text) agree on for it; where they don't, the label is UNCERTAIN
    and model_notes holds what competes. Nothing else is concluded, but that a rate held at 12% moved.
    Ids go on from first_id in the order of pos. A null text has no passage: UNCERTAIN, without a
    heading. Rows that quarantine's rules refuse are left out, unless it is off. No rows give no rows.
    """
    entries = lookup.rated_entries(notice).unionByName(lookup.amendments(pool.sparkSession))
    exempted, chapters = lookup.exempt_entries(exempt), lookup.chapter_entries(notice)
    q, o, turn = fresh(pool, "_quote"), fresh(pool, "_outcome"), fresh(pool, "_turn")
    df = operative_ruling(pool, text, q).withColumn(o, outcome(F.col(q)))
    df = placed(df.withColumn("heading", F.substring(F.get(f"{o}.headings", F.lit(0)), 1, 4)), {}, [pos], turn).drop(f"{turn}_of")
    asked = df.where("heading IS NOT NULL").select("heading").distinct()
    found = lookup.explained(lookup.match_headings(asked, entries, exempted, chapters), entries, exempted, chapters)
    m = found.select(F.col("heading").alias("_heading"), F.struct(*(c for c in found.columns if c != "heading")).alias("_match"))
    df = df.join(m, F.col("heading") == F.col("_heading"), "left")
    match, held, schedule = F.col("_match"), F.col(f"{o}.held"), F.col(f"{o}.schedule")
    label = F.coalesce(match["label"], F.lit(L.UNCERTAIN))
    n = F.size(match["alternatives"])
    where = F.when(match["schedule"].isNotNull(), _told("schedule ", match["schedule"])).otherwise(F.lit("the exempt list"))
    basis = (
        F.when(F.col("heading").isNull(), F.lit("no heading to look up"))
        .when(match["label"].isNotNull(), _told(F.col("heading"), " stands once, in ", where, ": ", F.substring(match["entry"], 1, 180)))
        .when(match["chapter_only"], _told(F.col("heading"), " has no entry; its chapter has ", n, ", whose exclusions must be read"))
        .when(match["ambiguous"] & match["decided_by"].isNotNull(), _told(F.col("heading"), " stands in ", n, " places, told apart by: ", match["decided_by"]))
        .when(match["ambiguous"], _told(F.col("heading"), " stands in ", n, " places; the goods decide"))
        .otherwise(_told(F.col("heading"), " has no entry, rated or exempt"))
    )
    moved = F.coalesce(held == "12", F.lit(False))
    notes = {
        "label_confidence": F.when(match["label"].isNotNull(), "grounded").otherwise("none"),
        "label_basis": basis,
        "label_alternatives": F.array_join(F.coalesce(match["alternatives"], F.array().cast("array<string>")), "\n"),
        "label_decided_by": match["decided_by"],
        "heading_confidence": F.when(F.col("heading").isNotNull(), "high").otherwise("none"),
        "heading_basis": F.when(F.col("heading").isNotNull(), _told("operative passage: ", F.array_join(f"{o}.headings", ", "), " (", F.col(f"{o}.confidence"), ")")).otherwise(F.lit("no operative passage")),
        "rate_moved": moved.cast("string"),
        "rate_moved_basis": _moved(held, schedule),
        "held_rate": held,
        "held_schedule": schedule,
        "conditional": F.coalesce(F.col(f"{o}.is_conditional"), F.lit(False)).cast("string"),
        "quote": F.substring(F.coalesce(F.col(q), F.lit("")), 1, QUOTE),
    }
    why = F.when(F.col("heading").isNull(), F.lit("Nothing in the text to ground a suggestion.")).otherwise(_told("Heading ", F.col("heading"), " as decided; ", F.when(match["label"].isNotNull(), _told(label, "%: ")).otherwise(F.lit("no label: ")), basis))
    out = df.select(
        F.format_string("gst-%04d", F.col(turn) + (first_id - 1)).alias("id"),
        "input",
        label.alias("label"),
        "heading",
        F.lit(True).alias("answerable"),
        why.alias("justification"),
        F.lit("hard").alias("difficulty"),
        F.when(moved, F.array(F.lit(CHANGED_TAG))).otherwise(F.array().cast("array<string>")).alias("tags"),
        *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("source", "source_id", "collected_at")),
        at.alias("labelled_at"),
        F.lit("model first pass; requires human review before use").alias("labeller_notes"),
        F.lit(FIRST_PASS).alias("labelled_by"),
        F.lit(None).cast("string").alias("deprecated_by"),
        F.map_filter(F.create_map(*(x for k, v in notes.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull()).alias("model_notes"),
    )
    return out.where(F.size(validation.problems(quarantine=True)) == 0) if quarantine else out


def derive_rows(first_pass: DataFrame, golden: DataFrame, at: Column) -> DataFrame:
    """First-pass rows that a lookup settled and golden doesn't have: derived rows, without the change tag.

    Their difficulty comes from the input's length; their notes say what the label rests on.
    """
    settled = first_pass.where((F.col("label") != L.UNCERTAIN) & (F.coalesce("heading", F.lit("")) != "")).join(golden.select("id"), "id", "left_anti")
    basis = F.substring(F.coalesce(F.try_element_at("model_notes", F.lit("label_basis")), F.lit("")), 1, BASIS)
    return settled.withColumns(
        {
            "difficulty": difficulty(F.col("input")),
            "labelled_by": F.lit(L.DERIVED[0]),
            "labelled_at": at,
            "labeller_notes": F.btrim(_told("label from the notification, heading from the decision; nobody confirmed it. ", basis)),
            "tags": F.array_remove(F.coalesce("tags", F.array().cast("array<string>")), CHANGED_TAG),
            "answerable": F.coalesce("answerable", F.lit(True)),
            "justification": F.coalesce("justification", F.lit("")),
        }
    )


def accept_review(suggested: DataFrame, label: Column, heading: Column, at: Column) -> DataFrame:
    """A reviewed suggestion: the annotator's label and heading, marked as human-reviewed."""
    return suggested.withColumns({"label": label, "heading": heading, "labelled_by": F.lit("human-reviewed"), "labelled_at": at})


def reextract(records: DataFrame, text: str, pages: str, most: int) -> DataFrame:
    """Records with their input cut anew from the source text: input, transforms, truncated, max_words.

    Rows go whose text is a scan, withdrawn, without a goods passage, or too short once cleaned. Rows
    whose text is null (the source isn't at hand) stay as they are.
    """
    x, cut, truncated, has, clean, applied = (fresh(records, n) for n in ("_excerpt", "_cut", "_truncated", "_has", "_clean", "_applied"))
    t = F.col(text)
    fit = t.isNotNull() & ~F.coalesce(is_scanned(t, F.col(pages)), F.lit(True)) & ~F.coalesce(is_withdrawn(t), F.lit(False))
    kept = {"input": "string", "transforms": "array<string>", "truncated": "boolean", "max_words": "int"}
    # neither the source text nor an input that will be replaced goes through the redactions
    old = {c: F.when(t.isNull(), F.col(c)) if c in records.columns else F.lit(None).cast(kind) for c, kind in kept.items()}
    df = records.withColumns({x: F.when(fit, goods_excerpt(t, most)), has: t.isNotNull(), **old})
    df = df.withColumns({cut: F.col(x)["excerpt"], truncated: F.col(x)["truncated"]}).drop(x)
    df = normalise(df, cut, ruling=True, out=clean, applied=applied)
    gaps = F.length(clean) - F.length(F.replace(F.col(clean), F.lit(" "), F.lit("")))  # between words: white space is squeezed
    df = filtered_here(df, ~F.col(has) | F.coalesce(gaps >= L.MIN_EXCERPT_WORDS - 1, F.lit(False)))
    new = {"input": F.col(clean), "transforms": F.col(applied), "truncated": F.col(truncated), "max_words": F.lit(most)}
    return df.withColumns({c: F.when(F.col(has), new[c]).otherwise(F.col(c)) for c in kept}).drop(cut, truncated, has, clean, applied)


def merged_transforms(*lists: Column) -> Column:
    """The sorted union of lists of transforms; a null list is empty."""
    out = F.array().cast("array<string>")
    for x in lists:
        out = F.array_union(out, F.coalesce(x, F.array().cast("array<string>")))
    return F.array_sort(out)
