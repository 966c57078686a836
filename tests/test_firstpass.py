"""First-pass rows, what they rest on, and records cut anew."""

import pytest
from pyspark.sql import functions as F

from assaykit.functions import text as T
from assaykit.operators import firstpass, lookup

NOTICE = (
    "Schedule I - 2.5% 1. 3307 Shaving cream, shaving lotion. 2. 1905 Bread [other than pizza bread]. "
    "Schedule II - 9% 1. 3307 All goods [other than shaving cream, shaving lotion]. 2. 8471 Machines of all kinds for all uses. "
)
EXEMPT = "1. 0401 Fresh milk, whole. 2. 1905 Plain chapati and roti. "
TAIL = " and the matter is disposed of accordingly after hearing all that was said for and against it in this case, as recorded above in the discussion."


def ruled(heading, rest):
    return "Discussion of facts. " * 40 + f"RULING: The goods are classifiable under heading {heading} {rest}" + TAIL


def suggestions(spark):
    texts = [ruled("3307", "at 9% CGST + 9% SGST"), ruled("8471", "Schedule II applies"), ruled("0401", ""), ruled("9999", ""), "no decision here", None, ruled("2403", "attracts 5%")]
    rows = [(k, "aar", f"s{k}", f"input {k}", "2026-01-01", t) for k, t in enumerate(texts)]
    pool = spark.createDataFrame(rows, "pos int, source string, source_id string, input string, collected_at string, ruling_text string").repartition(3)
    notice, exempt = (spark.createDataFrame([(x,)], "text string") for x in (NOTICE, EXEMPT))
    return firstpass.suggest(pool, notice, exempt, F.lit("2026-02-02"), first_id=41)


def test_suggest(spark):
    got = {r.source_id: r for r in suggestions(spark).collect()}
    assert [got[f"s{k}"].id for k in range(7)] == [f"gst-{41 + k:04d}" for k in range(7)]
    assert {k: (r.label, r.heading) for k, r in got.items()} == {"s0": ("UNCERTAIN", "3307"), "s1": ("18", "8471"), "s2": ("0", "0401"), "s3": ("UNCERTAIN", "9999"), "s4": ("UNCERTAIN", None), "s5": ("UNCERTAIN", None), "s6": ("UNCERTAIN", "2403")}
    notes = {k: r.model_notes for k, r in got.items()}
    assert notes["s0"]["label_decided_by"] == "shaving cream, shaving lotion" and len(notes["s0"]["label_alternatives"].split("\n")) == 2
    assert notes["s1"]["label_confidence"] == "grounded" and "schedule II" in notes["s1"]["label_basis"] and "exempt" in notes["s2"]["label_basis"]
    assert got["s1"].tags == ["rate-changed-2025"] and notes["s1"]["held_rate"] == "12" and got["s0"].tags == [] and notes["s0"]["held_rate"] == "18"
    assert "biris" in notes["s6"]["label_decided_by"].lower()
    assert {r.labelled_by for r in got.values()} == {"model-first-pass"} and {r.labelled_at for r in got.values()} == {"2026-02-02"}
    assert suggestions(spark).limit(0).count() == 0


def test_derive_and_review(spark):
    first = suggestions(spark)
    golden = first.where("source_id = 's2'")
    got = firstpass.derive_rows(first, golden, F.lit("2026-03-03")).collect()
    assert [(r.source_id, r.label, r.difficulty, r.labelled_by, r.tags) for r in got] == [("s1", "18", "typical", "gazette-derived", [])]
    assert "8471 stands once" in got[0].labeller_notes
    seen = firstpass.accept_review(first.where("source_id = 's0'"), F.lit("5"), F.col("heading"), F.lit("2026-03-04")).first()
    assert (seen.label, seen.heading, seen.labelled_by) == ("5", "3307", "human-reviewed")


@pytest.mark.parametrize(
    "entries,want",
    [
        (["All goods [other than Shaving cream]; other than shaving cream; other than soap 12"], "Shaving cream; soap"),
        (["x other than rice bran"], "rice bran"),
        (["x other than shaving cream, shavin …"], "shaving cream, shavin …"),
        (["all (other than medicaments) including sunscreen"], "medicaments"),
        (["no clause", "none here"], None),
        (["other than a1a", "other than b2b", "other than c3c", "other than d4d"], "a1a; b2b; c3c"),
        (["other than " + "word " * 30], "word " * 23 + "…"),
    ],
)
def test_decides_it(spark, entries, want):
    got = spark.range(1).select(lookup.decides_it(F.array(*map(F.lit, entries))).alias("x")).first().x
    assert got == want and (got is None or len(got) <= 200)


def test_reextract(spark):
    facts = "Brief facts of the case: the maker sells " + "combs and brushes of many kinds " * 12 + "FINDINGS follow. " + "x" * 300
    rows = [
        (1, facts, 2, "old", ["a"], 9),
        (2, facts, 900, "old", None, 9),  # a scan
        (3, facts + " permitted to withdraw the application", 2, "old", None, 9),
        (4, "nothing of the kind " * 40, 2, "old", None, 9),
        (5, None, None, "old", ["kept"], 9),  # the source isn't at hand
        (6, "Brief facts of the case: too short FINDINGS " + "x" * 400, 1, "old", None, 9),
        (7, facts.replace("maker", "M/s Blue Hill Traders Pvt. Ltd."), 2, "old", None, 9),
    ]
    df = spark.createDataFrame(rows, "k int, t string, pages int, input string, transforms array<string>, clean int")
    got = {r.k: r for r in firstpass.reextract(df, "t", "pages", 40).collect()}
    assert sorted(got) == [1, 5, 7]
    assert (got[5].input, got[5].transforms, got[5].truncated, got[5].clean) == ("old", ["kept"], None, 9)
    assert got[1].truncated and got[1].max_words == 40 and len(got[1].input.split()) == 40
    assert "Blue Hill" not in got[7].input and got[7].transforms


def test_merged_transforms_and_commands(spark):
    df = spark.createDataFrame([(["b", "a"], ["c", "a"]), (None, ["x"])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(firstpass.merged_transforms(F.col("a"), F.col("b")).alias("x")).collect()] == [["a", "b", "c"], ["x"]]
    typed = {"git push": True, "./run": True, ".\\run": True, "cd ../x y": True, "soap -n": True, "soap": False, "hair oil, 5 ml": False, "python": False}
    got = spark.createDataFrame([(k,) for k in typed], "t string").select("t", T.looks_like_command(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == typed


def test_hints(spark):
    df = spark.createDataFrame([("a", "", ["1", "2"], False, "s" * 300)], "categories string, state string, hsn_candidates array<string>, truncated boolean, labels string")
    got = df.select(T.label_hints({c: F.col(c) for c in df.columns} | {"rates": F.lit("12")}).alias("h")).first().h
    assert got == {"categories": "a", "hsn_candidates": "1, 2", "labels": "s" * 260}


def test_entities_as_html_reads_them(spark):
    import html

    texts = ["a &amp; b", "&lt;b&gt; &eacute;&#233;&#xe9;", "&notit; &copy &copy;", "AT&T &amp;lt; x", "&nbsp;x&nbsp;", "none", "&", "&hellip;&rarr;"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.decode_entities(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == {t: html.unescape(t) for t in texts}


def test_normalise_against_a_plain_version(spark):
    """Every document of the table, with a line of marks and compatibility characters after each third."""
    import re
    import unicodedata

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" ﬁne ★★ ( 4 / 5 ) buy  NOW a.b@c.co www.x.in/q +91 9876543210 ☎"))).otherwise(F.col("text")).alias("text"))
    steps = [(r"https?://\S+|www\.\S+", re.I), (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", 0), (r"(?:\+91[\s-]?)?\b\d{10}\b|\b\d{3,5}[\s-]\d{6,8}\b", 0), (T.FURNITURE, 0), (r"[★☆⭐✩✪✫✬✭✮✯]+|\(\s*\d+(?:\.\d+)?\s*/\s*5\s*\)", 0)]

    def plain(t):
        t = unicodedata.normalize("NFKC", t)
        for p, flags in steps:
            t = re.sub(p, " ", t, flags=flags)
        t = "".join(c for c in t if unicodedata.category(c) not in ("So", "Cs"))
        return re.sub(r"\s+", " ", t).strip(" \t\n\r-–—,;·|")

    got = T.normalise(docs, "text").collect()
    assert len(got) >= 200 and all(r.normalised == plain(r.text) for r in got)
