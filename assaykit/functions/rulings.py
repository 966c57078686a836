"""What a decision text holds: its operative passage, and the headings and rates it states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit import labels as L
from assaykit.functions.regex import every, found, once, places, rx, squeeze
from assaykit.functions.text import RATE_MENTION, heading_codes, normalise
from assaykit.shared import fresh

# --- fixed values: patterns and limits --------------------------------------------------------------
OPERATIVE = rx(r"(?:R\s?U\s?L\s?I\s?N\s?G\b|we\s+rule\s+as\s+under|[Rr]uling\s+is\s+given\s+as\s+under|[Tt]he\s+following\s+ruling\s+is\s+(?:passed|given)|ANSWER\s*:)", "i")
DETERMINATION = rx(
    r"\b(?:classifiab\w*|classif(?:ied|ication)|fall\w*\s+under|covered\s+by|merit\w*\s+classification|attract\w*|chargeable|taxable|liable\s+to\s+tax|would\s+not\s+be)\b", "i"
)
HEADING = rx(r"\b(?:HSN|HS\s+code|heading|chapter\s+heading|tariff\s+item|sub-?heading|C\.?\s?T\.?\s?H\.?|customs\s+tariff\s+heading)[^0-9\n]{0,25}(\d{4}(?:\s?\d{2}){0,2})", "i")
HEADING_MORE = rx(r"\b(?:or|and)\s+(\d{4}(?:\s?\d{2}){0,2})\b", "i")
SPLIT_RATE = rx(r"(\d{1,2}(?:\.\d+)?)\s*%\s*CGST", "i")
SCHEDULE = rx(r"Schedule\s*[-–—]?\s*(VII|VI|V|IV|III|II|I)\b", "i")
QUESTION = rx(r"\bWhether\b[^?]{0,240}\?|question\s+as\s+to", "i")
ANSWER = rx(r"\bAns(?:wer)?\b\s*[.:\-]|\bReply\b\s*[.:]", "i")
CONDITIONAL = rx(r"\bor\b.{0,40}\bdepend|depending\s+upon|whichever|as\s+the\s+case", "i")
TAIL_CHARS, QUOTE_CHARS = 150, 600
CONFIDENCE = ("low — reads like the question, not the ruling", "conditional — the heading depends on facts", "reads like a determination")
# ------------------------------------------------------------------------------------------------------


def operative_tail(text: Column) -> Column:
    """The text after the last operative marker of the final part that a determination follows, squeezed; or null."""
    floor = F.floor(F.length(text) * L.TAIL_FRACTION)

    def tail(m: Column) -> Column:
        return F.substring(text, m["start"] + F.length(m["match"]) + 1, F.lit(2 * QUOTE_CHARS))

    fit = F.filter(places(text, OPERATIVE), lambda m: (m["start"] >= floor) & (F.length(F.regexp_replace(tail(m), rx(r"^\s+|\s+$"), "")) >= TAIL_CHARS) & tail(m).rlike(DETERMINATION))
    return F.get(F.transform(F.slice(fit, -1, 1), lambda m: squeeze(tail(m))), F.lit(0))


def operative_ruling(df: DataFrame, column: str, out: str = "quote") -> DataFrame:
    """Adds the operative passage, redacted, up to QUOTE_CHARS characters; null where there is none."""
    tail, clean, applied = (fresh(df, x) for x in ("_tail_of_ruling", "_clean_tail", "_applied_to_tail"))
    df = normalise(df.withColumn(tail, operative_tail(F.col(column))), tail, ruling=True, out=clean, applied=applied)
    return df.withColumn(out, F.substring(clean, 1, QUOTE_CHARS)).drop(tail, clean, applied)


def _plain_number(x: Column) -> Column:
    """A number to six significant places without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), r"0+$", ""), r"\.$", "")


def outcome(quote: Column) -> Column:
    """Struct headings, rates, combined, conditional, question, schedule, held, confidence; null without a quote."""
    read = F.struct(
        F.array_distinct(F.concat(heading_codes(quote, HEADING), heading_codes(quote, HEADING_MORE))).alias("headings"),
        F.array_distinct(every(quote, RATE_MENTION, 1)).alias("rates"),
        found(quote, SPLIT_RATE, 1).cast("double").alias("half"),
        quote.rlike(CONDITIONAL).alias("conditional"),
        (quote.rlike(QUESTION) & ~quote.rlike(ANSWER)).alias("question"),
        F.upper(found(quote, SCHEDULE, 1)).alias("schedule"),
    )
    return F.when(quote.isNotNull(), once(read, _concluded))  # each pattern is searched for once


def _concluded(read: Column) -> Column:
    """What follows from what a quote has: see outcome."""
    headings, schedule = read["headings"], read["schedule"]
    ordered = F.transform(F.array_sort(F.transform(read["rates"], lambda r: F.struct(r.cast("double").alias("n"), r.alias("r")))), lambda x: x["r"])
    combined = F.when(read["half"].isNotNull(), _plain_number(read["half"] * 2))
    old = F.create_map(*(F.lit(x) for pair in L.OLD_SCHEDULE_LABEL.items() for x in pair))
    held = F.coalesce(F.get(F.filter(F.array(F.try_element_at(old, schedule)), lambda x: x.isNotNull()), F.lit(0)), combined, F.when(F.size(ordered) == 1, F.get(ordered, F.lit(0))))
    open_ = read["conditional"] | (F.size(headings) > 1)
    confidence = F.when(read["question"], CONFIDENCE[0]).when(open_, CONFIDENCE[1]).otherwise(CONFIDENCE[2])
    return F.struct(
        headings.alias("headings"),
        ordered.alias("rates"),
        combined.alias("combined"),
        read["conditional"].alias("conditional"),
        read["question"].alias("question"),
        schedule.alias("schedule"),
        held.alias("held"),
        open_.alias("is_conditional"),
        confidence.alias("confidence"),
    )
