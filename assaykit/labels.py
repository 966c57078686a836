"""The label space of the evaluated task, and the other closed domains, as plain tables."""

from __future__ import annotations

# --- fixed values: labels, dates, sources, reasons, thresholds ---------------------------------
VALID = ("0", "0.25", "1.5", "3", "5", "18", "40")
UNANSWERABLE = "UNANSWERABLE"
UNCERTAIN = "UNCERTAIN"
RETIRED = {"12": "2025-09-22", "28": "2026-02-01"}
TARGETS = {"typical": 0.40, "hard": 0.25, "long_context": 0.15, "adversarial": 0.10, "out_of_scope": 0.10}
REASONS = ("no-product-kind", "model-number-only", "rate-fact-absent", "packaging-indeterminate", "multi-good-no-dominant")
SOURCES = ("off", "aar", "ogd", "gem")
LABELLERS = ("human", "model-first-pass", "human-reviewed", "gazette-derived")
QUARANTINED = ("model-first-pass",)
DERIVED = ("gazette-derived",)
OUT_OF_SCOPE_TERMS = ("beer", "wine", "whisky", "whiskey", "whiskies", "vodka", "rum", "liquor", "alcoholic")
SCHEDULE_LABEL = {"I": "5", "II": "18", "III": "40", "IV": "3", "V": "0.25", "VI": "1.5", "VII": None}
OLD_SCHEDULE_LABEL = {"I": "5", "II": "12", "III": "18", "IV": "28", "V": "3", "VI": "0.25"}
FAMILIES = {
    "hair oil": ("hair oil", "coconut oil", "amla oil", "hair care oil"),
    "shampoo": ("shampoo",),
    "toothpaste": ("toothpaste", "tooth paste", "tooth powder", "dentifrice", "dant manjan"),
    "toothbrush": ("toothbrush", "tooth brush"),
    "toilet soap": ("bathing soap", "bath soap", "toilet soap", "bathing bar", "soap bar"),
    "shaving cream": ("shaving cream", "shaving gel", "shave cream"),
    "butter and ghee": ("butter", "ghee", "makhan"),
    "cheese": ("cheese", "dairy spread", "processed cheese"),
    "namkeen": ("namkeen", "bhujia", "mixture", "sev", "chivda", "farsan"),
    "sauces": ("sauce", "ketchup", "tomato puree"),
    "pasta and noodles": ("pasta", "noodle", "macaroni", "vermicelli", "spaghetti"),
    "chocolate": ("chocolate", "cocoa"),
    "coffee": ("coffee",),
    "cereal preparations": ("cornflake", "corn flake", "muesli", "breakfast cereal", "oats"),
    "biscuits": ("biscuit", "cookie", "cracker"),
}
CONTAINERS = ("pouch", "packet", "sachet", "bottle", "can", "carton", "box", "jar", "tin", "bag", "tube", "tetra pak", "tetrapak", "wrapper", "blister")
CLASSIFICATION_HINTS = ("classif", "hsn", "chapter heading", "tariff item", "tariff heading", "rate of tax", "rate of gst", "gst rate")
STATED_RATES = ("0", "0.25", "1.5", "3", "5", "12", "18", "28", "40")
AMENDMENTS = (
    ("2106", "2106 90 20", "III", "Pan masala"),
    ("2401", "", "III", "Unmanufactured tobacco; tobacco refuse [other than tobacco leaves]"),
    ("2402", "", "III", "Cigars, cheroots, cigarillos and cigarettes, of tobacco or of tobacco substitutes"),
    ("2403", "2403 19 21, 2403 19 29", "II", "Biris"),
    ("2403", "2403 (other than 2403 19 21, 2403 19 29)", "III", "Other manufactured tobacco and manufactured tobacco substitutes; homogenised or reconstituted tobacco; tobacco extracts and essences [other than biris]"),
    ("2404", "2404 11 00", "III", "Products containing tobacco or reconstituted tobacco and intended for inhalation without combustion"),
    ("2404", "2404 19 00", "III", "Products containing tobacco or nicotine substitutes and intended for inhalation without combustion"),
)
AMENDMENT_PREFIX = "[Notification 19/2025, in force 2026-02-01] "
KAPPA_BANDS = ((0.40, "unusable"), (0.60, "moderate"), (0.80, "substantial"), (None, "strong"))
DRIFT, MIN_LENGTH, MAX_LENGTH, LONG_WORDS = 0.05, 8, 12_000, 800
CHARS_PER_PAGE, MIN_EXCERPT_WORDS, TAIL_FRACTION = 200, 25, 0.55
KEY_CHARS, AGREEMENT_FLOOR, KAPPA_FLOOR, RUPEES = 400, 0.85, 0.40, 88.0
# -----------------------------------------------------------------------------------------------
