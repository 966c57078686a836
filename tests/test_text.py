import pytest
from pyspark.sql import functions as F

from assaykit.functions import rulings, text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def normalised(spark, t, ruling=False):
    return T.normalise(spark.createDataFrame([(t,)], "t string"), "t", ruling).first()


@pytest.mark.parametrize(
    "raw,clean,applied",
    [
        ("Soap, 75 g", "Soap, 75 g", []),
        ("  Soap\n bar ★★★ - ", "Soap bar", ["strip_rating", "collapse_ws"]),
        ("Buy now! see www.x.in/a or mail a.b@c.co", "! see or mail", ["strip_url", "strip_email", "strip_furniture", "collapse_ws"]),
        ("ﬁne oil ☎ 9876543210", "fine oil", ["nfkc", "strip_phone", "strip_emoji", "collapse_ws"]),
        ("rated ( 4.5 / 5 ) jam", "rated jam", ["strip_rating", "collapse_ws"]),
    ],
)
def test_normalise(spark, raw, clean, applied):
    got = normalised(spark, raw)
    assert (got.normalised, got.applied) == (clean, applied)


@pytest.mark.parametrize(
    "raw,gone,kept",
    [
        ("M/s Green Valley Foods Pvt. Ltd. makes rusks of wheat flour", "Green Valley", "rusks of wheat flour"),
        ("GSTIN 27ABCDE1234F1Z5 is for paper cups", "27ABCDE1234F1Z5", "paper cups"),
        ("Shri Ravi Kumar appeared. The goods are tiles", "Ravi", "goods are tiles"),
        ("Anil Mehta, Advocate spoke of steel nails", "Mehta", "steel nails"),
        ("No. 14, Third Cross, Lake Road Pune. Glass beads", "Lake Road", "Glass beads"),
        ("Page 2 of 14 the goods are combs", "Page 2", "goods are combs"),
        ("PAN: ABCDE1234F and brushes", "ABCDE1234F", "brushes"),
    ],
)
def test_redaction(spark, raw, gone, kept):
    got = normalised(spark, raw, True).normalised
    assert gone not in got and kept in got
    assert normalised(spark, got, True).normalised == got


def test_goods_survive_redaction(spark):
    t = "Heading 3307 covers shaving cream in 6 tubes of 70 g, sold with a brush; it is taxed at 18%."
    assert normalised(spark, t, True).normalised == t


def test_screens(spark):
    assert one(spark, T.out_of_scope_term(F.lit("Two WINES"))) == "wines"
    assert one(spark, T.out_of_scope_term(F.lit("a rumble of winery"))) is None
    assert one(spark, T.is_scanned(F.lit("x" * 500), F.lit(2))) is False and one(spark, T.is_scanned(F.lit("x"), F.lit(0))) is True
    assert one(spark, T.is_withdrawn(F.lit("they were permitted to withdraw it"))) is True
    assert one(spark, T.oversize(F.lit(None).cast("double"), 5.0, F.lit(False))) is False
    assert one(spark, T.candidate_families(F.lit("Coconut oil shampoos and biscuit"))) == ["hair oil", "shampoo", "biscuits"]
    assert one(spark, T.difficulty(F.lit("w " * 800))) == "long_context" and one(spark, T.difficulty(F.lit(""))) == "typical"


def test_listing(spark):
    d = lambda *x: one(spark, T.describe_listing(*(F.lit(v).cast("string") for v in x)))
    assert d("Oat Bar", "Acme,Other", "40 g", "en:box, paper") == "Acme Oat Bar, 40 g, box"
    assert d("ACME Oat Bar", "acme", "forty", "foil") == "ACME Oat Bar"
    assert d(" ", "Acme", "40 g", "box") == "" and d(None, None, None, None) == ""


def test_excerpt(spark):
    t = "Head. The applicant is engaged in " + "making cups " * 20 + "RULING: no"
    x = one(spark, T.goods_excerpt(F.lit(t), 30))
    assert x.truncated and x.excerpt.startswith("The applicant is engaged in making") and len(x.excerpt.split()) == 30
    assert one(spark, T.goods_excerpt(F.lit("The applicant is engaged in cups. RULING"), 30)) is None
    assert one(spark, T.goods_excerpt(F.lit("nothing here " * 40), 30)) is None


def test_codes(spark):
    assert one(spark, T.heading_candidates(F.lit("HSN 3307 and heading 1975; chapter 8471 30 00, HSN 3307"))) == ["3307", "84713000"]
    assert one(spark, T.stale_rates(F.lit("5% 12 % 18% 7% 5%"))) == ["12", "18", "5"]


def test_outcome(spark):
    t = "facts " * 100 + "RULING: The goods are classifiable under HSN 3307 and 2106 at 6% CGST. " + "so it is held " * 12
    df = rulings.operative_ruling(spark.createDataFrame([(t,), ("RULING early " + "facts " * 100,), ("x" * 300 + " RULING: taxable",)], "t string"), "t")
    got = [r.o for r in df.select(rulings.outcome(F.col("quote")).alias("o")).collect()]
    assert (got[0].headings, got[0].rates, got[0].combined, got[0].held, got[0].is_conditional) == (["3307", "2106"], ["6"], "12", "12", True)
    assert got[1] is None and got[2] is None
    q = one(spark, rulings.outcome(F.lit("Whether soap is taxable at 18%? Schedule II")))
    assert q.question and q.schedule == "II" and q.held == "12" and q.confidence.startswith("low")


def test_html(spark):
    assert one(spark, T.strip_html(F.lit("<p>a &amp;  b</p><br>c&nbsp;&lt;d"))) == "a & b c <d"


def test_known_party(spark):
    import hashlib

    h = hashlib.sha256(b"acme-co").hexdigest()
    assert one(spark, T.strip_known_parties(F.lit("by Acme-Co, not acme"), (h,))) == "by  , not acme"


def test_families_in_one_search(spark):
    import re

    from assaykit import labels as L
    from assaykit.functions.regex import trie
    from assaykit.functions.text import candidate_families

    odd = {"a": ("pea", "pea soup", "soup"), "b": ("pea soup mix", "soups"), "c": ("c++", "mix"), "d": ("peas",)}
    texts = ["", "Pea", "peas soup", "pea soups", "pea soup mix", "PEA SOUP MIXES", "peapod soup", "c++ mix", "a c++s", "mix-soups", "soupſ", "peas\u00a0soup", "xpea", "pea_soup", "pea\nsoup"]
    goods = [t for own in L.FAMILIES.values() for t in own]
    whole = texts + goods + [f"{t}s, {u.upper()}" for t in goods for u in goods[::7]] + [f"{t}y {t}" for t in goods]
    for families in (odd, L.FAMILIES):
        df = spark.createDataFrame([(t,) for t in whole], "t string")
        got = {r.t: r.f for r in df.select("t", candidate_families(F.col("t"), families).alias("f")).collect()}
        for t in whole:
            assert got[t] == [n for n, own in families.items() if re.search(rf"\b(?:{'|'.join(map(re.escape, own))})s?\b", t, re.I)], t
    words = ["ab", "abc", "b", "abd", "c.d"]
    assert [re.match(trie(words), x)[0] for x in ("abcx", "abx", "abd", "bb", "c.d")] == ["abc", "ab", "abd", "b", "c.d"] and not re.match(trie(words), "cxd")
