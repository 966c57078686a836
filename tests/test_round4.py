"""What the fourth round of findings asked for."""

from collections import Counter

from assaykit.operators import rescreen

KIND = "source_id string, source string, input string, pos long, brief string, categories string, labels string, transforms array<string>"
#: doc_ids: rulings that no rule of their brief takes, then listings
RULINGS, LISTINGS = [k for k in range(0, 3000, 3) if k % 5 in (0, 3, 4) and k % 41 and k % 21], [k for k in range(2000, 6000) if k % 3 and k % 41 and k % 21 and k % 10 != 7 and k % 13]


def by_sql(spark, folder, documents: list) -> tuple[Counter, Counter]:
    """rescreened_pool's rows and its SQL's; doc_ids 5 and 9 are labelled."""
    import duckdb

    from assaykit.plans.flows import QUERIES, SQL

    con = duckdb.connect()
    for name, rows, schema in (("documents", documents, "doc_id long, text string"), ("labels", [(5,), (9,), (9,)], "doc_id long")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    got = QUERIES["rescreened_pool"](spark, str(folder)).collect()
    return Counter(map(tuple, got)), Counter(con.execute(SQL["rescreened_pool"]).fetchall())


TEXTS = [
    # a ruling's names, numbers and addresses go, and with them its key and its length
    "sold by Mr. Anand Rao in lots", "sold by in lots", "soap of 29ABCDE1234F1Z5 kind", "soap of kind", "bars, 560 001. Soap", "soap to pan ABCDE1234F", "Mr. Anand", "x" * 11_995 + " Mr. Rao Anand",
    # NFKC writes these as letters and digits
    "ﬁne soap in lots", "ne soap in lots", "soap x² in lots", "soap x in lots", "①②③④⑤⑥⑦⑧", "cups ½",
    # classes, word ends and letters without regard to case
    "soap wine² bar", "soap wıne bar", "Ⓐrum of soap", "beer‿ of soap", "whiſky soap", "éturnkey soap", "turnkeyé soap", "job work of soap", "énot maintainable", "not maintainable", "éhurry of soap", "josé@mail.example.com soap", "soap a@b.example.comé", "clıck here soap", "clicK here soap", "12345 678901 soap", "soap  bar", "٣٤٥٦٧٨٩٠١٢ soap",
    # words of the first 200, between separators
    "x " * 198 + "a\x1cb wine", "x " * 199 + "a\x1fb wine",
    # no text isn't an empty one, nor one without letters of a key
    None, "", "!!!!!!!!!!", "ÉÉÉÉÉÉÉÉÉÉ",
]


def test_reasons_are_those_of_the_sql(spark, tmp_path):
    # differed from its SQL wherever a ruling's redactions, NFKC, Unicode's classes or null texts told
    rows = [(ids[4 * k + j], t) for k, t in enumerate(TEXTS) for j in range(2) for ids in (RULINGS, LISTINGS)] + [(5, TEXTS[0]), (9, TEXTS[-1])]
    got, want = by_sql(spark, tmp_path, rows)
    assert got == want


def test_an_id_that_repeats_makes_no_rows(spark, tmp_path):
    # rows were looked up by pos alone: two first texts of one pos gave four rows, and the first of one key held for another
    a, b, c = LISTINGS[:3]
    got, want = by_sql(spark, tmp_path, [(a, "soap in bars"), (b, "soap in bars"), (b, "soap in boxes"), (c, "flakes in boxes"), (c, "flakes in bags")])
    assert got == want and sum(got.values()) == 5


def test_plain_rows_are_redacted_all_the_same(spark):
    made = [(str(k), "aar", t, k, "soap", "", "", None) for k, t in enumerate(["sold by Mr. Anand Rao in lots", "sold by Mr. Suresh Rao in lots", None, None])]
    pool, none = spark.createDataFrame(made, KIND), spark.createDataFrame([], "source_id string")
    plain = rescreen.rescreened(pool, none, plain=True).orderBy("pos").collect()
    whole = rescreen.rescreened(pool, none).orderBy("pos").collect()
    assert [r.reason for r in plain] == ["kept", "kept", "kept", "duplicate"] and [r.reason for r in whole] == ["kept", "duplicate", "length", "length"]
    assert [(r.input, r.transforms, r.redacted) for r in plain[:2]] == [(r.input, r.transforms, r.redacted) for r in whole[:2]] and "Rao" not in plain[0].input and plain[2].input is None


def test_patterns_as_re2_reads_them():
    from assaykit.functions import text
    from assaykit.functions.regex import ASCII_EDGE, ascii_rx, rx

    assert ascii_rx(rx(r"\b\w+[\s\d-]\S", "i")) == rf"(?di){ASCII_EDGE}[0-9A-Za-z_]+[\t\n\f\r 0-9-][^\t\n\f\r ]"
    assert ascii_rx(rx(r"(?i)sk[sk]\.p{2}")) == "(?di)[sſ][kK][sſkK]\\.p{2}" and ascii_rx(rx("sk")) == "(?d)sk"
    assert text.ASCII_EDGE == ASCII_EDGE
