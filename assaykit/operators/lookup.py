"""Headings in a schedule text: positions, enclosing schedules, entries, and what they agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit import labels as L
from assaykit.functions.regex import every, places, rx, squeeze

# --- fixed values: patterns and widths --------------------------------------------------------------
SCHEDULE_HEAD = rx(r"Schedule\s+(VII|VI|V|IV|III|II|I)\s*[-–—]{0,2}\s*([\d.]+)\s*%", "i")
NEXT_SERIAL = rx(r"\s\d{1,3}\s*\.\s+(?=\d{4}|\d{2}\b|[A-Z])")
EXCLUSION = rx(r"other\s+than\s+([^\].;…)]{3,160})(\s*…)?", "i")
CLAUSE, CLAUSES, JOINED, FEW = 120, 3, 200, 3  # characters of a clause, clauses that are told, characters of these, letters that "…" takes
SERIAL_CHAPTER = rx(r"(?:^|[^\d])\d{1,3}\s*\.\s*(\d{2})\s*(?:\[[^\]]*\]\s*)?(?=[A-Z])")
BACK, FORWARD, SHORT = 160, 320, 60
# ------------------------------------------------------------------------------------------------------


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the right row of its keys with the greatest since <= at; nulls before the first.

    One sort of both sides together: no pairs are made. Of equal since the greatest values count.
    """
    cols = left.columns
    r = right.groupBy(*keys, since).agg(F.max(F.struct(*values)).alias("_v"))
    l_ = left.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*cols).alias("_row"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"))
    r_ = r.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(since).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(l_.schema["_row"].dataType).alias("_row"), "_v")
    w = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l_.unionByName(r_).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_row.*", *(F.col("_last")[v].alias(v) for v in values))


def heading_positions(text: Column, pattern: str = rx(r"\b\d{4}\b")) -> Column:
    return F.transform(places(text, pattern), lambda m: F.struct((m["start"]).alias("at"), m["match"].alias("heading")))


def schedule_bounds(text: Column) -> Column:
    return F.transform(places(text, SCHEDULE_HEAD), lambda m: F.struct(m["start"].alias("at"), F.upper(F.regexp_extract(m["match"], SCHEDULE_HEAD, 1)).alias("schedule")))


def enclosing(bounds: Column, at: Column) -> Column:
    """The schedule whose heading stands last at or before a position; null before the first. A text has few bounds."""
    before = F.filter(bounds, lambda b: b["at"] <= at)
    return F.get(before, F.size(before) - 1)["schedule"]


def entry_text(text: Column, at: Column) -> Column:
    """The entry around a position: back to the last full stop, on to the next serial number."""
    lo = F.greatest(F.lit(0), at - BACK)
    back = F.substring(text, lo + 1, at - lo)
    stop = F.locate(" .", F.reverse(back))
    start = F.when(stop > 0, at - stop + 1).otherwise(F.greatest(F.lit(0), at - SHORT))
    chunk = squeeze(F.substring(text, start + 1, at + FORWARD - start))
    rest = F.substring(chunk, F.lit(13), F.length(chunk))
    cut = F.regexp_instr(rest, F.lit(NEXT_SERIAL))
    whole = F.length(text) <= at + FORWARD
    ended = F.when(whole, chunk).otherwise(F.concat(chunk, F.lit(" …")))
    return F.when(cut > 0, F.regexp_replace(F.substring(chunk, F.lit(1), F.lit(11) + cut), r"\s+$", "")).otherwise(ended)


def _labels() -> Column:
    return F.create_map(*(F.lit(x) for k, v in L.SCHEDULE_LABEL.items() if v is not None for x in (k, v)))


def rated_entries(notice: DataFrame, text: str = "text") -> DataFrame:
    """(heading, schedule, label, entry, place): of each heading's mentions in a schedule the one whose entry begins with it, else the first. Schedule VII is left out. place: where the schedule first mentions it."""
    m = notice.select(F.col(text).alias("t"), schedule_bounds(F.col(text)).alias("b"), F.explode(heading_positions(F.col(text))).alias("m"))
    m = m.select(F.col("m.heading").alias("heading"), F.col("m.at").alias("at"), enclosing(F.col("b"), F.col("m.at")).alias("schedule"), entry_text(F.col("t"), F.col("m.at")).alias("entry"))
    own = F.struct(F.when(F.col("entry").startswith(F.col("heading")), 0).otherwise(1).alias("k"), "at", "entry")
    best = m.where("schedule IS NOT NULL AND schedule <> 'VII'").groupBy("heading", "schedule").agg(F.min(own).alias("x"), F.min("at").alias("place"))
    return best.select("heading", "schedule", F.try_element_at(_labels(), F.col("schedule")).alias("label"), F.col("x.entry").alias("entry"), F.col("place").cast("long").alias("place"))


def amendments(spark) -> DataFrame:
    """Entries that came later, placed after those of any text."""
    rows = [(h, s, L.SCHEDULE_LABEL[s], L.AMENDMENT_PREFIX + f"{sub or h} {text}", (1 << 40) + k) for k, (h, sub, s, text) in enumerate(L.AMENDMENTS)]
    return spark.createDataFrame(rows, "heading string, schedule string, label string, entry string, place long")


def chapter_entries(notice: DataFrame, text: str = "text") -> DataFrame:
    """(chapter, schedule, label, entry): the first serial of a schedule that names a whole chapter."""
    found = F.transform(places(F.col(text), SERIAL_CHAPTER), lambda m: F.struct((m["start"] + F.regexp_instr(m["match"], F.lit(rx(r"\d{2}\s*(?:\[[^\]]*\]\s*)?$"))) - 1).alias("at"), F.regexp_extract(m["match"], SERIAL_CHAPTER, 1).alias("chapter")))
    m = notice.select(F.col(text).alias("t"), schedule_bounds(F.col(text)).alias("b"), F.explode(found).alias("m"))
    m = m.select(F.regexp_extract(F.substring(F.col("t"), F.col("m.at") + 1, F.lit(2)), r"(\d{2})", 1).alias("chapter"), F.col("m.at").alias("at"), enclosing(F.col("b"), F.col("m.at")).alias("schedule"), entry_text(F.col("t"), F.col("m.at")).alias("entry"))
    best = m.where("schedule IS NOT NULL AND chapter <> ''").groupBy("chapter", "schedule").agg(F.min(F.struct("at", "entry")).alias("x"))
    return best.select("chapter", "schedule", F.try_element_at(_labels(), F.col("schedule")).alias("label"), F.col("x.entry").alias("entry"), F.col("x.at").cast("long").alias("place"))


def exempt_entries(notice: DataFrame, text: str = "text") -> DataFrame:
    """(heading, entry, place): entries of the exempt list, one for each beginning of 80 characters."""
    m = notice.select(F.col(text).alias("t"), F.explode(heading_positions(F.col(text))).alias("m"))
    m = m.select(F.col("m.heading").alias("heading"), F.col("m.at").alias("at"), entry_text(F.col("t"), F.col("m.at")).alias("entry"))
    first = m.groupBy("heading", F.substring("entry", 1, 80).alias("_k")).agg(F.min(F.struct("at", "entry")).alias("x"))
    return first.select("heading", F.col("x.entry").alias("entry"), F.col("x.at").cast("long").alias("place"))


def match_headings(headings: DataFrame, entries: DataFrame, exempt: DataFrame, chapters: DataFrame) -> DataFrame:
    """For each heading what its entries agree on.

    entries: (heading, schedule, label, entry) with amendments; exempt: (heading, entry) adds label 0;
    chapters count only for headings with neither, and never settle a label. An entry without a
    label (its schedule has none) is an outcome of its own.
    """
    h = headings.select(F.substring("heading", 1, 4).alias("heading")).distinct()
    e = entries.groupBy("heading").agg(F.collect_set(F.coalesce("label", F.lit("?"))).alias("_labels"), F.collect_set("schedule").alias("_schedules"), F.count("*").alias("n_entries"))
    x = exempt.groupBy("heading").agg(F.count("*").alias("n_exempt"))
    c = chapters.groupBy("chapter").agg(F.collect_set(F.coalesce("label", F.lit("?"))).alias("_chapter"), F.count("*").alias("n_chapter"))
    df = h.join(e, "heading", "left").join(x, "heading", "left").join(c, F.substring("heading", 1, 2) == F.col("chapter"), "left")
    none = F.array().cast("array<string>")
    n_entries, n_exempt = F.coalesce("n_entries", F.lit(0)), F.coalesce("n_exempt", F.lit(0))
    bare = (n_entries == 0) & (n_exempt == 0)
    outcomes = F.array_union(F.coalesce("_labels", none), F.when(n_exempt > 0, F.array(F.lit("0"))).otherwise(none))
    outcomes = F.when(bare, F.coalesce("_chapter", none)).otherwise(outcomes)
    df = df.select("heading", n_entries.alias("n_entries"), n_exempt.alias("n_exempt"), F.when(bare, F.coalesce("n_chapter", F.lit(0))).otherwise(0).alias("n_chapter"), F.array_sort(outcomes).alias("outcomes"), F.coalesce("_schedules", none).alias("_s"))
    ambiguous, chapter_only = F.size("outcomes") > 1, F.col("n_chapter") > 0
    label = F.when((F.size("outcomes") == 1) & ~chapter_only, F.nullif(F.get("outcomes", F.lit(0)), F.lit("?")))
    schedule = F.when(~ambiguous & (F.col("n_entries") > 0) & (F.size("_s") == 1), F.get("_s", F.lit(0)))
    return df.select("heading", "n_entries", "n_exempt", "n_chapter", ambiguous.alias("ambiguous"), chapter_only.alias("chapter_only"), label.alias("label"), schedule.alias("schedule"))


def deciding_clauses(entry: Column) -> Column:
    """Exclusion clauses of an entry, tidied, distinct whatever their case.

    A clause that the entry's own "…" cuts ends with one; a long one is cut at a word, with one.
    """

    def tidy(m: Column) -> Column:
        c = F.btrim(F.regexp_replace(squeeze(F.regexp_extract(m, EXCLUSION, 1)), r"\s+\d{1,3}\s*$", ""), F.lit(" ,.;]"))
        c = F.when(F.regexp_extract(m, EXCLUSION, 2) != "", F.concat(c, F.lit(" …"))).otherwise(c)
        return F.btrim(_cut(c, CLAUSE))

    return _distinct_texts(F.filter(F.transform(every(entry, EXCLUSION), tidy), lambda c: c != ""))


def _cut(text: Column, most: int) -> Column:
    """A text of more than `most` characters up to its last whole word that leaves room for "…"."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most - FEW), " [^ ]*$", ""), F.lit(" …"))).otherwise(text)


def _distinct_texts(texts: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.aggregate(texts, empty, lambda acc, c: F.when(F.exists(acc, lambda o: F.lower(o) == F.lower(c)), acc).otherwise(F.concat(acc, F.array(c))))


def decides_it(entries: Column) -> Column:
    """What separates some entries, in their own words: the first exclusion clauses of all of them; null without any."""
    clauses = _distinct_texts(F.flatten(F.transform(entries, deciding_clauses)))
    return F.when(F.size(clauses) > 0, _cut(F.array_join(F.slice(clauses, 1, CLAUSES), "; "), JOINED))


def explained(matches: DataFrame, entries: DataFrame, exempt: DataFrame, chapters: DataFrame) -> DataFrame:
    """matches (of match_headings) with alternatives, decided_by and entry.

    alternatives: what competes for an ambiguous heading, or what its chapter says; decided_by:
    decides_it of an ambiguous heading's own entries; entry: the first of a settled one. A heading has a
    few entries, one for each schedule.
    """

    def listed(df: DataFrame, key: str, kind: int) -> DataFrame:
        schedule = F.col("schedule") if "schedule" in df.columns else F.lit(None).cast("string")
        label = F.col("label") if "label" in df.columns else F.lit("0")
        return df.select(F.col(key).alias("_key"), F.struct(F.lit(kind).alias("kind"), "place", schedule.alias("schedule"), label.alias("label"), "entry").alias("_x"))

    own = listed(entries, "heading", 0).unionByName(listed(exempt, "heading", 1)).groupBy("_key").agg(F.array_sort(F.collect_list("_x")).alias("_own"))
    wide = listed(chapters, "chapter", 2).groupBy("_key").agg(F.array_sort(F.collect_list("_x")).alias("_wide"))
    df = matches.join(own.withColumnRenamed("_key", "_k1"), F.col("heading") == F.col("_k1"), "left").join(wide.withColumnRenamed("_key", "_k2"), F.substring("heading", 1, 2) == F.col("_k2"), "left")
    none = F.array().cast(df.schema["_own"].dataType)
    shown = F.concat(F.coalesce("_own", none), F.when(F.col("chapter_only"), F.coalesce("_wide", none)).otherwise(none))

    def line(x: Column) -> Column:
        where = F.when(x["kind"] == 1, F.lit("exempt")).when(x["kind"] == 2, F.concat_ws(" ", F.lit("chapter"), F.substring("heading", 1, 2), F.lit("schedule"), x["schedule"])).otherwise(F.concat_ws(" ", F.lit("schedule"), x["schedule"]))
        return F.concat(where, F.lit(" = "), F.coalesce(x["label"], F.lit("?")), F.lit("%: "), F.substring(x["entry"], 1, 150))

    empty = F.array().cast("array<string>")
    lines = F.when(F.col("ambiguous") | F.col("chapter_only"), F.transform(shown, line)).otherwise(empty)
    decided = F.when(F.col("ambiguous"), decides_it(F.transform(F.coalesce("_own", none), lambda x: x["entry"])))
    return df.select(*matches.columns, lines.alias("alternatives"), decided.alias("decided_by"), F.when(F.col("label").isNotNull(), F.get("_own", F.lit(0))["entry"]).alias("entry"))
