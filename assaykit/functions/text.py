"""Text columns: normalisation and redaction, screens, keys, listings, excerpts."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit import labels as L
from assaykit.functions.regex import ASCII_EDGE, ascii_rx, every, found, once, one_of, places, rx, squeeze, tokens, trie, word_count
from assaykit.shared import fresh

# --- fixed values: patterns of what is stripped, in the order of application ---------------------
_MS = r"M\s*/\s*s\.?\s*(?!No\b|No\.)"
_NEXT_FIELD = r"(?=\s*(?:Address\b|GSTIN\b|Case\s+No|ARN\b|Date\s+of\b|Order\s+(?:number|no)\b|Applicant|Present\s+for\b|\d+\.\s|$))"
RULING_PATTERNS = (
    ("applicant_field", rx(r"\bName\s+of\s+the\s+[Aa]pplicant\s*:?\s*.{0,140}?" + _NEXT_FIELD, "is")),
    ("address_field", rx(r"\bAddress\s*:?\s*.{0,220}?" + _NEXT_FIELD, "is")),
    ("representative", rx(r"(?:Applicant.{0,3}s\s+representative\s+heard|Present\s+for\s+the\s+applicant)\s*:?\s*.{0,140}?(?=\s*(?:\d+\.\s|$))", "is")),
    ("gstin", rx(r"\b\d{2}[A-Za-z0-9]{13}\b")),
    ("pan", rx(r"\bPAN\s*(?:No\.?|Number)?\s*[-:]?\s*(?=[A-Za-z0-9]{10}\b)(?=[A-Za-z0-9]*\d)[A-Za-z0-9]{10}\b|\b[A-Za-z]{5}\d{4}[A-Za-z]\b")),
    ("arn", rx(r"\bAD\d{9,}[A-Z\d]*\b", "i")),
    ("registered_office", rx(r"\b(?:registered|corporate|head|branch)\s+office\s*(?:is\s+)?(?:at|in|situated\s+at|located\s+at)?\s*(?:[^.]|\.(?=\s*\d)){0,160}", "i")),
    (
        "company",
        rx(
            rf"\b(?:{_MS}|Messrs\.?\s*)[A-Z][\w&.'\- ]{{2,60}}?"
            r"(?:Private\s+Limited|Pvt\.?\s*Ltd\.?|Public\s+Limited|Limited|Ltd\.?|Private|Pvt\.?|LLP|Industries|Enterprises?|Corporation|Corp\.?|Company|Traders?|Mills|Works|Agencies|Associates)\b"
            r"(?:\s*(?:Pvt\.?|Ltd\.?|Limited|Private|LLP|Inc\.?|Co\.?)\b)*",
            "i",
        ),
    ),
    ("applicant", rx(rf"\b(?:{_MS}|Messrs\.?\s*)[A-Z][\w&.'\- ]{{2,80}}?(?=\s*(?:[,.()]|having\b|is\b|has\b|the applicant\b|$))", "i")),
    ("ms_name", rx(rf"\b{_MS}[A-Z][\w.&'\-]*(?:\s+[A-Z][\w.&'\-]*){{0,5}}")),
    ("person_name", rx(r"\b(?:Sri|Shri|Smt|Mr|Ms|Mrs|Dr)\.?\s+(?!No\.)[A-Z][\w.\-]{1,24}(?:\s+[A-Z][\w.\-]{1,24}){0,3}")),
    (
        "role_name",
        rx(
            r"\b[A-Z][\w.\-]{1,24}(?:\s+[A-Z][\w.\-]{1,24}){0,3}"
            r"(?=\s*,\s*(?:Advocates?|Chartered\s+Accountants?|C\.?A\.?\b|F\.?C\.?A\.?\b|Consultants?|Tax\s+Consultants?|Authoris(?:ed)?\s+Representative|Authoriz(?:ed)?\s+Representative|Prop\b))"
        ),
    ),
    ("proprietor", rx(r"\b[Pp]rop(?:rietor)?\.?\s*(?:of|:)?\s*\.?\s*[A-Z][\w.\-]{1,30}(?:\s+[A-Z][\w.\-]{1,30}){0,2}")),
    ("alias", rx(r"\b(?:herein\s*after|hereinafter)\s+(?:called|referred)\s+(?:as|to\s+as)\s*\.?\s*[A-Z][\w.\-]{1,30}")),
    ("business_address", rx(r"\bdoing\s+business\s+at\b[^.]{0,160}", "i")),
    ("street_address", rx(r"\b(?:No\.\s*)?\d[\w\-/]*\s*,[^.]{0,120}?[A-Z][\w]+\s+(?:Road|Street|Nagar|Lane|Colony|Layout|Cross|Block|Marg|Sarani)\b[^.]{0,60}")),
    ("address", rx(r"[^.]{0,120}?(?=\d{6})\b\d{6}\b|(?=\d)\b\d{3}\s?\d{3}\b(?=\s*[.,])")),  # digits are looked for before word ends: these cost more
    ("page_marker", rx(r"\bPage\s+\d+\s+of\s+\d+\b", "i")),
    ("appeal_notice", rx(r"(?:Note\s*:\s*)?Any\s+appeal\s+against\s+(?:the|this)\s+[Aa]dvance\s+[Rr]uling.{0,400}?(?:is\s+communicated|communicated)\s*\.?", "is")),
    ("outset_recital", rx(r"At\s+the\s+outset,?\s+we\s+would\s+like\s+to\s+make\s+it\s+clear.{0,400}?(?:\bare\s+the\s+same\b|\bpari\s*materia\b|\.)", "is")),
    ("admissibility_recital", rx(r"Advance\s+ruling\s+is\s+admissible\s+on\s+.{0,120}?section\s*97\s*\(\s*2\s*\)[^.]{0,60}\.", "is")),
    ("pending_declaration", rx(r"The\s+[Aa]pplicant\s+declares\s+th\s?at\s+the\s+issue\s+raised.{0,300}?admissibility\s+of\s+the\s+[Aa]pplication\s*\.", "is")),
)
FURNITURE = (
    r"(?i)\b(?:buy\s+now|shop\s+now|free\s+delivery|free\s+shipping|cash\s+on\s+delivery|best\s+seller|bestseller|limited\s+(?:time\s+)?offer|hurry|sale\s+ends"
    r"|lowest\s+price|deal\s+of\s+the\s+day|new\s+arrival|out\s+of\s+stock|click\s+here|order\s+online)\b"
)
COMMON_PATTERNS = (
    ("url", rx(r"https?://\S+|www\.\S+", "i")),
    ("email", rx(r"\b[\w.+-]+@[\w-]+\.[\w.]+\b")),
    ("phone", rx(r"(?:\+91[\s-]?)?\b\d{10}\b|\b\d{3,5}[\s-]\d{6,8}\b")),
    (
        "furniture",
        rx(FURNITURE),
    ),
    ("rating", rx(r"[★☆⭐✩✪✫✬✭✮✯]+|\(\s*\d+(?:\.\d+)?\s*/\s*5\s*\)")),
)
KNOWN_PARTIES = (
    "612f58a5a81eaeb83c0a05e2402cacb3e513ff06947d9bb154c22518f3fa2168",
    "3f40f767428a2a97b0e193ea6eac7a3db1ba7c0711af4ed0d5c972932b071612",
    "43d2242f526a93c0ac2c7575109da34e7da8fb19d9fc448114e11a10e2e8c589",
    "45b72f147be46d52cd8a793ea67f31b64d940ccad87c2befa670d1851069bdf8",
)
PARTY_WORD = rx(r"\b[A-Za-z][A-Za-z0-9'\-]{2,}\b")
EMOJI = r"[\p{So}\p{Cs}]"
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # \s
EDGES = " \t\n\r-–—,;·|"
QUANTITY = rx(r"\d\s*(?:g|gm|gms|gram|kg|mg|ml|l|ltr|lt|litre|liter|cl|oz|lb|pc|pcs|piece|pieces|pack|packs|n|no|nos|dozen)\b", "i")
STATUTE = rx(r"Goods?\s+and\s+Services?\s+(?:Tax\s+)?(?:Act|Rules)?|GST\s+Act", "i")
SERVICE_STRONG = rx(
    r"\b(?:works\s+contract|job\s*work|EPC\s+contract|turnkey|erection[,\s]+testing|supply\s+of\s+services?\b|SAC\s+code|Government\s+(?:Entity|Authority)"
    r"|limb\s+of\s+(?:the\s+)?Government|execution\s+of\s+(?:the\s+)?work)\b|\bwork(?:s)?\b[^.]{0,40}\b(?:executed|awarded)\b",
    "i",
)
SERVICE_WEAK = rx(
    r"\b(?:services?|renting|rental|leasing|lease|transport(?:ation)?\s+of|consultancy|repair(?:ing|s)?|maintenance|installation|manpower|catering(?!\s+to)|canteen|hostel"
    r"|accommodation|admission|training|coaching|tour\s+operator|commission\s+agent|lodging|boarding\s+house|printing|storage|warehousing|hiring|erection|commissioning)\b",
    "i",
)
SERVICE_NOTIFICATION = rx(r"\b11\s*/\s*2017\s*[-–—]?\s*(?:CT|C\.?T\.?|Central\s+Tax|IT|Integrated\s+Tax)", "i")
IMMOVABLE = rx(
    r"transfer\s+of\s+leasehold|leasehold\s+rights?|immovable\s+propert|residential\s+(?:flats?|units?|apartments?)|completion\s+certificate|development\s+rights?"
    r"|sale\s+of\s+land|allotment\s+of\s+land|share\s+of\s+(?:the\s+)?land",
    "i",
)
CLAUSE_A = rx(r"97\s*\(\s*2\s*\)[^a-z]*\(\s*a\s*\)", "i")
WITHDRAWN = rx(r"\b(?:request(?:ed)?\s+(?:to\s+|for\s+)?withdraw|permitted\s+to\s+withdraw|withdrawn\s+by\s+the\s+applicant|application\s+is\s+(?:hereby\s+)?withdrawn|not\s+maintainable|rejected\s+as\s+inadmissible)\b", "i")
GOODS_START = rx(
    r"(?:[Bb]rief\s+facts?(?:\s+of\s+the\s+case)?\s*:?|[Ss]tatement\s+of\s+(?:relevant\s+)?facts|[Tt]he\s+[Aa]pplicant\s+is\s+stated\s+to\s+be"
    r"|[Tt]he\s+[Aa]pplicant[^.]{0,120}?submitted\s+that|[Tt]he\s+[Aa]pplicant\s+is\s+(?:a\s+|an\s+)?[^.]{0,60}?engaged\s+in|applicant\s+is\s+engaged\s+in"
    r"|[Tt]he\s+[Aa]pplicant\s+(?:manufactures|produces|deals\s+in|proposes\s+to))",
    "s",
)
GOODS_END = rx(r"(?:\bDISCUSSION\b|\bFINDINGS?\b|\bPERSONAL\s+HEARING\b|\bRULING\b|\bWe\s+have\s+(?:gone\s+through|considered|carefully)|\bQUESTIONS?\s+(?:ON\s+WHICH|RAISED))", "s")
HEADING_MENTION = rx(r"\b(?:HSN|H\.?S\.?N\.?|heading|chapter|tariff\s+item|sub-?heading)[^0-9\n]{0,25}(\d{4}(?:\s?\d{2}){0,2})", "i")
RATE_MENTION = rx(r"(\d{1,2}(?:\.\d+)?)\s*%")
COMMAND = rx(r"^(?:python\d?|py|pip\d?|pytest|git|npm|node|pwsh|powershell|docker)\b|^cd\s+(?:\S*[\\/]|\.\.)|\s--?[A-Za-z]", "i")
HINTS = ("categories", "quantity", "labels", "state", "order_no", "hsn_candidates", "ruling_brief", "ruling_url", "pdf_pages", "truncated")
LISTS = ("hsn_candidates",)
OUT_OF_SCOPE = rx(rf"\b(?:{one_of(L.OUT_OF_SCOPE_TERMS)})(?:e?s)?\b", "i")
_NO_MORE = r"[\p{L}\p{M}\p{N}_]"  # what goes on with a word, by the SQL of screens
PLAIN_OUT_OF_SCOPE = rf"(?<!{_NO_MORE})(?:{ascii_rx(rx(rf'(?:{one_of(L.OUT_OF_SCOPE_TERMS)})(?:e?s)?', 'i'))})(?!{_NO_MORE})"
# -------------------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def nfkc(s):
    """No built-in function normalises Unicode."""
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


#: Characters that patterns without regard to case take for ASCII's letters.
_TAKEN_FOR = {"\u017f": "s", "\u212a": "k", "\u0131": "i", "\u0130": "i"}


def folded(text: Column) -> Column:
    """The text in lower case: a pattern without regard to case matches no ASCII letters but those found here."""
    odd = (F.octet_length(text) != F.length(text)) & text.rlike(f"[{''.join(_TAKEN_FOR)}]")
    return F.lower(F.when(odd, F.translate(text, "".join(_TAKEN_FOR), "".join(_TAKEN_FOR.values()))).otherwise(text))


def has_any(text: Column, pieces: tuple[str, ...]) -> Column:
    some = F.lit(False)
    for piece in pieces:
        some = some | F.contains(text, F.lit(piece))
    return some


def strip_emoji(text: Column) -> Column:
    return F.regexp_replace(text, EMOJI, "")


def trim_edges(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, rx(r"\s+"), " "), F.lit(EDGES))


def plain_edges(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[\t\n\x0b\f\r ]+", " "), F.lit(EDGES))


def strip_known_parties(text: Column, hashes: tuple[str, ...] = KNOWN_PARTIES) -> Column:
    """Words whose lower-case SHA-256 is among hashes become a space."""
    party = lambda w: F.sha2(F.lower(w).cast("binary"), 256).isin(*hashes)
    told = lambda w: F.when(party(w), F.lit(" ")).otherwise(w)
    # both arrays are made once for a text: pieces, one more than words, then the word after each
    whole = F.zip_with(F.split(text, PARTY_WORD, -1), every(text, PARTY_WORD), lambda piece, w: F.concat(piece, F.coalesce(told(w), F.lit(""))))
    # each different word is hashed once; most texts have none of them and stay
    return F.when(F.exists(F.array_distinct(every(text, PARTY_WORD)), party), F.array_join(whole, "")).otherwise(text)


#: Cheap signs without which a costly pattern can't match.
SIGNS = {
    "pan": rx(r"(?=[P\d])(?:PAN|\d{4}[A-Za-z])"),
    "arn": rx(r"\d{9}"),
    "company": rx(r"M\s*/\s*s|Messrs", "i"),
    "applicant": rx(r"M\s*/\s*s|Messrs", "i"),
    "ms_name": rx(r"M\s*/\s*s"),
    "role_name": rx(r",\s*[ACFPT]"),
    "street_address": rx(r"\d[\w\-/]*\s*,"),
    "address": rx(r"\d{3}\s?\d{3}"),  # also of a sentence
    "phone": rx(r"\d{6}"),
    "rating": r"[★☆⭐✩✪✫✬✭✮✯]|/\s*5",
}
#: What a match begins with, where that is cheaper to look for than a word's end.
FIRST = {"gstin": r"\d", "person_name": "[SMD]", "role_name": "[A-Z]", "proprietor": "[Pp]"}
#: Patterns that match no full stop, and look no further than one: each sentence with the sign is searched alone.
BY_SENTENCE = ("address",)
#: Characters beyond ASCII that are their own form in NFKC, beside any others of these.
_OWN_FORM = "\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u00ff\u0152\u0153\u2013\u2014\u2018-\u201e\u2022\u20ac\u20b9"
NOT_OWN_FORM = rf"[\x80-\x{{10ffff}}&&[^{_OWN_FORM}]]"
#: Pieces of text of which one must be there, in lower case, without regard to case. None holds white space: as what is
#: stripped becomes a space, a piece that the text lacked before is never made by stripping.
PIECES = {
    "applicant_field": ("applicant",),
    "address_field": ("address",),
    "representative": ("applicant",),
    "registered_office": ("office",),
    "company": ("/", "messrs"),
    "applicant": ("/", "messrs"),
    "ms_name": ("/",),
    "proprietor": ("prop",),
    "alias": ("herein",),
    "business_address": ("business",),
    "page_marker": ("page",),
    "appeal_notice": ("appeal",),
    "outset_recital": ("outset",),
    "admissibility_recital": ("admissible",),
    "pending_declaration": ("declares",),
    "url": ("://", "www."),
    "email": ("@",),
    "furniture": ("buy", "shop", "free", "cash", "seller", "offer", "hurry", "sale", "price", "deal", "arrival", "stock", "click", "online"),
    "rating": ("/", *"★☆⭐✩✪✫✬✭✮✯"),
}


def by_sentence(text: Column, pattern: str, sign: str) -> Column:
    """Matches become a space; each piece up to a full stop is searched alone, if it has the sign."""
    pieces = F.split(text, r"(?<=\.)", -1)
    return F.array_join(F.transform(pieces, lambda s: F.when(s.rlike(sign), F.regexp_replace(s, pattern, " ")).otherwise(s)), "")


def normalise(df: DataFrame, column: str, ruling: bool = False, out: str = "normalised", applied: str = "applied", unicode: bool = True, plain: bool = False) -> DataFrame:
    """Adds the normalised text and the ordered names of the transforms that changed it.

    plain: patterns know ASCII's classes alone, as in SQL, and NFKC is left out.

    Each step is a column of its own, computed once from the one before; every pattern takes out
    something that isn't white space, so a step fired where its text differs from the last.
    """
    # texts that are their own form stay in the JVM; Java takes a class that leaves out many ranges some twenty times as long as one that begins at 0x80
    steps = [("nfkc", lambda t: F.coalesce(nfkc(F.when(t.rlike(NOT_OWN_FORM), t)), t))] if unicode and not plain else []
    first, low = len(steps), fresh(df, "_low")

    def strip(name: str, pattern: str):
        pattern = ascii_rx(pattern) if plain else pattern

        def run(t: Column) -> Column:
            new = F.regexp_replace(t, rx(f"(?={FIRST[name]})(?:{pattern})") if name in FIRST else pattern, " ")
            if name in BY_SENTENCE:
                new = by_sentence(t, pattern, SIGNS[name])
            signs = [has_any(F.col(low), PIECES[name])] if name in PIECES else []
            signs += [t.rlike(SIGNS[name])] if name in SIGNS else []
            return F.when(reduce(and_, signs), new).otherwise(t) if signs else new

        return f"strip_{name}", run

    if ruling:
        steps += [strip(*p) for p in RULING_PATTERNS] + [("strip_known_party", strip_known_parties)]
    steps += [strip(*p) for p in COMMON_PATTERNS] + [("strip_emoji", strip_emoji), ("collapse_ws", plain_edges if plain else trim_edges)]
    t = [fresh(df, f"_step{k}") for k in range(len(steps) + 1)]
    fired = [fresh(df, f"_fired{k}") for k in range(len(steps))]
    df = df.withColumn(t[0], F.col(column))
    for k, (_, run) in enumerate(steps):  # pieces are looked for in the text before the first one is stripped; a step's text goes as soon as the next one's is compared with it
        if k == first:
            df = df.withColumn(low, folded(F.col(t[k])))
        df = df.withColumns({t[k + 1]: run(F.col(t[k]))} | ({fired[k - 1]: F.col(t[k]) != F.col(t[k - 1])} if k else {}))
    df = df.withColumn(fired[-1], F.col(t[-1]) != F.col(t[-2]))
    names = F.array_compact(F.array(*(F.when(F.col(f), F.lit(name)) for f, (name, _) in zip(fired, steps))))
    return df.withColumns({out: F.col(t[-1]), applied: names}).drop(*t, *fired, low)


def in_length_bounds(text: Column) -> Column:
    return F.length(text).between(L.MIN_LENGTH, L.MAX_LENGTH)


def out_of_scope_term(text: Column, plain: bool = False) -> Column:
    """plain: words end where the screens' SQL has them."""
    return F.lower(found(text, PLAIN_OUT_OF_SCOPE if plain else OUT_OF_SCOPE))


def scope_text(excerpt: Column, brief: Column) -> Column:
    """The brief and the excerpt's first 200 words."""
    return F.concat_ws(" ", F.coalesce(brief, F.lit("")), F.array_join(F.slice(tokens(F.translate(F.coalesce(excerpt, F.lit("")), "\x1c\x1d\x1e\x1f", "    ")), 1, 200), " "))


def listing_scope_text(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts))


def is_about_services(brief: Column, excerpt: Column | None = None, plain: bool = False) -> Column:
    read = ascii_rx if plain else str
    strong = F.regexp_replace(scope_text(excerpt if excerpt is not None else F.lit(""), brief), read(STATUTE), " ")
    weak = F.regexp_replace(F.coalesce(brief, F.lit("")), read(STATUTE), " ")
    return strong.rlike(read(SERVICE_STRONG)) | strong.rlike(read(SERVICE_NOTIFICATION)) | weak.rlike(read(SERVICE_WEAK))


def is_about_immovable(brief: Column) -> Column:
    return F.coalesce(brief, F.lit("")).rlike(IMMOVABLE)


def is_classification(category: Column, brief: Column) -> Column:
    text = F.lower(F.coalesce(brief, F.lit("")))
    hinted = F.lit(False)
    for hint in L.CLASSIFICATION_HINTS:
        hinted = hinted | text.contains(hint)
    return ~is_about_services(brief) & ~is_about_immovable(brief) & (F.coalesce(category, F.lit("")).rlike(CLAUSE_A) | hinted)


def is_withdrawn(text: Column, plain: bool = False) -> Column:
    return once(folded(text), lambda low: has_any(low, ("withdraw", "maintainable", "inadmissible"))) & text.rlike(ascii_rx(WITHDRAWN) if plain else WITHDRAWN)


def is_scanned(text: Column, pages: Column) -> Column:
    return (pages <= 0) | F.coalesce(F.length(text) / F.nullif(pages, F.lit(0)) < L.CHARS_PER_PAGE, F.lit(False))


def oversize(size_mb: Column, most: float, cached: Column) -> Column:
    """Known to be too large, and not at hand; an unknown size isn't."""
    return F.coalesce(size_mb > F.lit(most), F.lit(False)) & ~cached


def _family_hits(families: dict[str, tuple[str, ...]]) -> dict[str, list[str]]:
    """For each term, the families that a text has where that term is the longest one: its own, and those of terms that it begins with, as whole words."""
    terms = [(t, name) for name, own in families.items() for t in own]
    return {w: [name for name in families if any(f == name and (w == t or re.match(rf"{re.escape(t)}s?\b", w)) for t, f in terms)] for w, _ in terms}


def candidate_families(text: Column, families: dict[str, tuple[str, ...]] | None = None, edge: str = r"\b") -> Column:
    """All families of which a text has a term, as a whole word or with an s, in the families' order.

    The text is searched once: at each word's beginning for the longest term of any family. Words end
    where edge says, by default at what is no letter or digit of any script; ASCII_EDGE knows ASCII's alone.
    """
    families = families or L.FAMILIES
    hits = _family_hits(families)
    terms = F.array_distinct(F.transform(every(text, rx(rf"{edge}(?=({trie(hits)})s?{edge})", "i"), 1), lambda t: F.translate(F.lower(t), "\u017f", "s")))
    told = F.create_map(*(x for w, names in hits.items() for x in (F.lit(w), F.array(*map(F.lit, names)))))
    return F.array_intersect(F.array(*map(F.lit, families)), F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(told, t), F.array().cast("array<string>")))))


def difficulty(text: Column) -> Column:
    return F.when(word_count(text) >= L.LONG_WORDS, F.lit("long_context")).otherwise(F.lit("typical"))


def dedupe_key(text: Column, most: int | None = L.KEY_CHARS) -> Column:
    key = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")
    return F.substring(key, 1, most) if most else key


def clean_quantity(raw: Column) -> Column:
    q = squeeze_ends(F.coalesce(raw, F.lit("")))
    return F.when(q.rlike(QUANTITY), q).otherwise(F.lit(""))


def squeeze_ends(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def clean_packaging(raw: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda p: F.replace(F.regexp_replace(F.lower(squeeze_ends(p)), "^en:", ""), F.lit("-"), F.lit(" ")))
    return F.coalesce(F.get(F.filter(parts, lambda p: p.isin(*L.CONTAINERS)), F.lit(0)), F.lit(""))


def describe_listing(name: Column, brands: Column, quantity: Column, packaging: Column) -> Column:
    """Brand (unless the name has it), name, quantity with a unit, container; '' without a name."""
    title = squeeze_ends(F.coalesce(name, F.lit("")))
    brand = squeeze_ends(F.get(F.split(F.coalesce(brands, F.lit("")), ","), F.lit(0)))
    head = F.when((brand != "") & ~F.contains(F.lower(title), F.lower(brand)), F.concat_ws(" ", brand, title)).otherwise(title)
    whole = F.array_join(F.filter(F.array(head, clean_quantity(quantity), clean_packaging(packaging)), lambda x: x != ""), ", ")
    return F.when(title == "", F.lit("")).otherwise(whole)


def goods_excerpt(text: Column, most: int) -> Column:
    """(excerpt, truncated) from the first start marker to the first end marker 40 characters on; null if under 25 words."""

    def body(rest: Column) -> Column:
        after = F.substring(rest, F.lit(41), F.length(rest))
        return once(F.regexp_instr(after, F.lit(rx(f"(?=[DFPRWQ])(?:{GOODS_END})"))), lambda stop: squeeze_ends(F.when(stop > 0, F.substring(rest, F.lit(1), F.lit(39) + stop)).otherwise(rest)))

    def excerpt(whole: Column, words: Column) -> Column:
        cut = F.size(words) > most
        out = F.struct(F.when(cut, F.array_join(F.slice(words, 1, most), " ")).otherwise(whole).alias("excerpt"), cut.alias("truncated"))
        return F.when(F.size(words) >= L.MIN_EXCERPT_WORDS, out)

    rest = once(F.regexp_instr(text, F.lit(GOODS_START)), lambda start: F.when(start > 0, F.substring(text, start, F.length(text))))
    first = max(most, L.MIN_EXCERPT_WORDS) + 1  # words told apart; what follows them is one more
    return once(once(rest, body), lambda whole: once(F.split(whole, rx(r"\s+"), first), lambda words: excerpt(whole, words)))


def heading_codes(text: Column, pattern: str, most: int | None = None) -> Column:
    """Codes of up to 8 digits in the order of first mention; 4-digit years 19xx and 20xx aren't any."""
    codes = F.transform(every(text, pattern, 1), lambda c: F.substring(F.regexp_replace(c, rx(r"\s+"), ""), 1, 8))
    distinct = F.array_distinct(F.filter(codes, lambda c: ~((F.length(c) == 4) & (c.startswith("19") | c.startswith("20")))))
    return F.slice(distinct, 1, most) if most else distinct


def heading_candidates(text: Column) -> Column:
    return heading_codes(text, HEADING_MENTION, 12)


def stale_rates(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(every(text, RATE_MENTION, 1), lambda r: r.isin(*L.STATED_RATES))))


@F.pandas_udf(T.StringType())
def unescape(s):
    """No built-in function knows all named and numbered entities of HTML."""
    import html

    return s.map(lambda x: None if x is None else html.unescape(x))


def strip_html(html: Column, common: bool = False) -> Column:
    """Tags become spaces, entities their characters, as HTML 5 reads them (or the common ones alone); white space is squeezed."""
    return squeeze(decode_entities(F.regexp_replace(html, "<[^>]+>", " "), common))


def decode_entities(text: Column, common: bool = False) -> Column:
    """Common entities by replacing them; texts with any other '&' by unescape, the only ones that leave the JVM.

    With common, other entities, and those without their semicolon, stay as they are written.
    """
    # --- fixed values: entities that can't be the beginning of another one's name
    plain = text
    for entity, char in (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    replaced = F.replace(plain, F.lit("&amp;"), F.lit("&"))
    if common:
        return replaced
    rest = F.replace(plain, F.lit("&amp;"), F.lit(""))
    other = F.contains(rest, F.lit("&"))
    return F.coalesce(unescape(F.when(other, text)), replaced)


def looks_like_command(text: Column) -> Column:
    """Whether what was typed as an answer is a shell command."""
    return F.substring(text, 1, 2).isin("./", ".\\") | (F.contains(text, F.lit(" ")) & text.rlike(COMMAND))


def label_hints(meta: dict[str, Column], most: int = 260) -> Column:
    """A map of what a labeller may see of a record: names of HINTS to short texts; nulls, '', false and empty lists are left out.

    meta: columns by name; lists as arrays of strings. candidate_families and the decision's outcome are shown beside it.
    """

    def text(name: str, c: Column) -> Column:
        flat = F.array_join(c, ", ") if name in LISTS else c.cast("string")
        return F.substring(F.when(~flat.isin("", "false"), flat), 1, most)

    pairs = [x for name in HINTS if name in meta for x in (F.lit(name), text(name, meta[name]))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def mentions_near(text: Column, pattern: str, group: str, unless: str, before: int, after: int) -> Column:
    """Distinct groups, in order, of matches without `unless` in the text around them."""

    def window(m: Column) -> Column:
        begin = F.greatest(F.lit(0), m["start"] - before)
        return F.substring(text, begin + 1, m["start"] + F.length(m["match"]) + after - begin)

    ok = F.filter(places(text, pattern), lambda m: ~window(m).rlike(unless))
    return F.array_distinct(F.transform(ok, lambda m: F.regexp_extract(m["match"], group, 1)))
