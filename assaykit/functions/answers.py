"""Model answers: prompts, parsing, citations of retired labels, row scores, judge verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit import labels as L
from assaykit.functions.regex import found, one_of, rx, squeeze
from assaykit.functions.text import mentions_near, squeeze_ends
from assaykit.shared import fresh

# --- fixed values: line formats, words of the past, limits -----------------------------------------
LABEL_LINE = rx(r"^\s*SLAB\s*[:\-]\s*(.+?)\s*$", "im")
HEADING_LINE = rx(r"^\s*HSN\s*[:\-]\s*(.+?)\s*$", "im")
ANSWERABLE_LINE = rx(r"^\s*ANSWERABLE\s*[:\-]\s*(.+?)\s*$", "im")
WHY_LINE = rx(r"^\s*WHY\s*[:\-]\s*(.+?)\s*$", "ims")
VERDICT_LINE = rx(r"^\s*VERDICT\s*[:\-]\s*(.+?)\s*$", "im")
REASON_LINE = rx(r"^\s*REASON\s*[:\-]\s*(.+?)\s*$", "ims")
NO_ANSWER = rx(r"\bUNANSWERABLE\b|\bCANNOT\b|\bUNKNOWN\b", "i")
RETIRED_MENTION = rx(rf"(?<![\d.])({one_of(L.RETIRED)})\s*(?:%|per\s*ce?nt\b|percent\b)", "i")
RETIRED_START = rx(rf"^({one_of(L.RETIRED)})")
HISTORICAL = rx(
    r"\b(?:was|were|used\s+to|previously|formerly|earlier|erstwhile|hitherto|prior\s+to|before|until|till|up\s*to|upto|then[-\s]existing|abolish\w*|omitt?\w*|remov\w*"
    r"|withdraw\w*|superseded?|replac\w*|no\s+longer|ceased?|discontinu\w*|revised?|changed?|pre[-\s]?2025|since|w\.e\.f\.?|with\s+effect\s+from)\b",
    "i",
)
BEFORE, AFTER, WHY_CHARS, REASON_CHARS = 120, 90, 600, 400
PROMPT_VERSION = "v1"
# -----------------------------------------------------------------------------------------------------


def prompt(template: str, description: Column) -> Column:
    """The template with the trimmed description in place of {description}."""
    head, _, tail = template.partition("{description}")
    return F.concat(F.lit(head), squeeze_ends(description), F.lit(tail))


def normal_label(raw: Column, number: Column | None = None) -> Column:
    """The label that a SLAB line states, or null; number: the first number in it, if it is at hand."""
    number = _number(raw) if number is None else number
    plain = F.regexp_replace(number, r"\.0$", "")
    return F.when(raw.rlike(NO_ANSWER), F.lit(L.UNANSWERABLE)).when(number != "", plain)


def _number(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(\d+(?:\.\d+)?)", 1)


def _code(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(\d{4})", 1)


def answer_lines(text: Column) -> dict[str, Column]:
    """What the four lines of an answer say, '' for a line that isn't there: each one search of the text."""
    t = F.coalesce(text, F.lit(""))
    return {name: F.regexp_extract(t, line, 1) for name, line in (("label", LABEL_LINE), ("heading", HEADING_LINE), ("answerable", ANSWERABLE_LINE), ("why", WHY_LINE))}


def read_lines(label: Column, heading: Column, answerable: Column, why: Column, number: Column, code: Column, said: Column) -> dict[str, Column]:
    """label, heading, answerable, why and unparseable of an answer's lines, the number in the first, the code in the second, and the label that is said; no SLAB line: unparseable and nulls."""
    ok = label != ""
    yes = F.when(answerable != "", answerable.rlike(rx(r"\byes\b|\btrue\b", "i")))
    return {
        "label": F.when(ok, said),
        "heading": F.when(ok & (code != "") & ~heading.rlike(rx(r"\bNONE\b|\bN/?A\b", "i")), code),
        "answerable": F.when(ok, F.coalesce(yes, said != L.UNANSWERABLE)),
        "why": F.when(ok, F.substring(squeeze(why), 1, WHY_CHARS)).otherwise(F.lit("")),
        "unparseable": ~ok,
    }


def parse_answer(text: Column) -> Column:
    """Struct label, heading, answerable, why, unparseable of an answer; see with_answer for plans that read several fields."""
    lines = answer_lines(text)
    fields = read_lines(**lines, number=_number(lines["label"]), code=_code(lines["heading"]), said=normal_label(lines["label"]))
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def with_answer(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """df with the fields of parse_answer as columns of that prefix. Each line is searched once, whatever is read of it."""
    raw = {n: fresh(df, f"_line_{n}") for n in ("label", "heading", "answerable", "why", "number", "code", "said")}
    df = df.withColumns({raw[n]: c for n, c in answer_lines(F.col(text)).items()})
    label, heading = F.col(raw["label"]), F.col(raw["heading"])
    df = df.withColumns({raw["number"]: _number(label), raw["code"]: _code(heading)})
    df = df.withColumn(raw["said"], normal_label(label, F.col(raw["number"])))
    fields = read_lines(**{n: F.col(c) for n, c in raw.items()})
    return df.withColumns({f"{prefix}{n}": c for n, c in fields.items()}).drop(*raw.values())


def retired_citations(text: Column) -> Column:
    """Retired labels stated as current, distinct, in the order of their first mention."""
    return F.coalesce(mentions_near(text, RETIRED_MENTION, RETIRED_START, HISTORICAL, BEFORE, AFTER), F.array().cast("array<string>"))


def score_fields(gold: Column, gold_heading: Column, label: Column, heading: Column, unparseable: Column, errored: Column, cited: Column) -> dict[str, Column]:
    """Credits of an answer. An error or an unparseable answer earns none but keeps its citations."""
    void = F.coalesce(errored, F.lit(False)) | unparseable
    same = F.coalesce(heading == gold_heading, F.lit(False)) & (gold_heading != "")
    chapter = F.coalesce(F.substring(heading, 1, 2) == F.substring(gold_heading, 1, 2), F.lit(False)) & (gold_heading != "")
    abstained = F.when(label.isNotNull() & (label != ""), (label != L.UNANSWERABLE) == (gold != L.UNANSWERABLE)).otherwise(F.lit(False))
    no = F.lit(False)
    return {
        "label_correct": F.when(void, no).otherwise(label.eqNullSafe(gold)),
        "heading_correct": F.when(void, no).otherwise(F.coalesce(same, no)),
        "chapter_correct": F.when(void, no).otherwise(F.coalesce(chapter, no)),
        "abstention_correct": F.when(void, no).otherwise(abstained),
        "retired": F.when(~void & label.isin(*L.RETIRED), label),
        "retired_cited": cited,
        "unparseable": unparseable,
        "errored": F.coalesce(errored, no),
        "predicted": F.when(~void, label),
        "gold": gold,
    }


def score_answer(gold: Column, gold_heading: Column, parsed: Column, errored: Column, text: Column) -> Column:
    """Struct of credits, from a parsed answer."""
    fields = score_fields(gold, gold_heading, parsed["label"], parsed["heading"], parsed["unparseable"], errored, retired_citations(F.coalesce(text, F.lit(""))))
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def recites_retired(score: Column) -> Column:
    return score["retired"].isNotNull() | (F.size(score["retired_cited"]) > 0)


def judge_prompt(rubric: str, description: Column, heading: Column, label: Column, why: Column) -> Column:
    """Fills {description}, {gold_hsn}, {gold_slab} and {justification} of the rubric."""
    out = F.lit(rubric)
    told = F.coalesce(F.nullif(why, F.lit("")), F.lit("(the model gave no explanation)"))
    for name, value in (
        ("{gold_hsn}", F.coalesce(F.nullif(heading, F.lit("")), F.lit("(none established)"))),
        ("{gold_slab}", label),
        ("{description}", F.substring(squeeze_ends(description), 1, 2000)),
        ("{justification}", F.substring(squeeze_ends(told), 1, 1500)),
    ):
        out = F.replace(out, F.lit(name), value)
    return out


def parse_verdict(text: Column) -> Column:
    """Struct passed, reason, label: FAIL is looked for first; neither word: unparseable."""
    t = F.coalesce(text, F.lit(""))
    raw = F.upper(F.regexp_extract(t, VERDICT_LINE, 1))
    passed = F.when(raw.contains("FAIL"), F.lit(False)).when(raw.contains("PASS"), F.lit(True))
    reason = F.when(passed.isNotNull(), F.substring(squeeze(F.regexp_extract(t, REASON_LINE, 1)), 1, REASON_CHARS)).otherwise(F.lit(""))
    return F.struct(passed.alias("passed"), reason.alias("reason"), F.when(passed, "PASS").when(~passed, "FAIL").otherwise("UNPARSEABLE").alias("label"))


#: What of a chat-completions body is read.
RESPONSE = (
    "struct<id:string,model:string,choices:array<struct<finish_reason:string,message:struct<content:string,reasoning_content:string>>>,"
    "usage:struct<prompt_tokens:int,completion_tokens:int,prompt_tokens_details:struct<cached_tokens:int>>>"
)


def decode_response(body: Column, model: Column, provider: Column) -> Column:
    """A chat-completions body as a completion; reasoning is measured, never merged into the text."""
    b = F.from_json(body, RESPONSE)
    first = F.get(b["choices"], F.lit(0))
    details = b["usage"]["prompt_tokens_details"]
    return F.struct(
        F.coalesce(first["message"]["content"], F.lit("")).alias("text"),
        F.coalesce(F.nullif(b["model"], F.lit("")), model).alias("model"),
        provider.alias("provider"),
        F.coalesce(b["usage"]["prompt_tokens"], F.lit(0)).alias("tokens_in"),
        F.coalesce(b["usage"]["completion_tokens"], F.lit(0)).alias("tokens_out"),
        F.coalesce(details["cached_tokens"], F.lit(0)).alias("cached_tokens_in"),
        b["id"].alias("request_id"),
        first["finish_reason"].alias("stop_reason"),
        F.when(first.isNull(), F.lit("empty_response: no choices returned")).alias("error"),
        F.length(F.coalesce(first["message"]["reasoning_content"], F.lit(""))).alias("reasoning_chars"),
    )


def request_body(model: Column, prompt: Column, system: Column | None, style: Column, thinking: Column, max_tokens: Column) -> Column:
    """A chat-completions request as JSON. style says how a model family is told to reason; what doesn't fit the style is left out.

    chat_template: chat_template_kwargs.enable_thinking; system_toggle: a leading system message;
    effort: reasoning_effort, max or low; others: nothing.
    """
    message = "struct<role:string,content:string>"

    def said(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content")).cast(message)

    toggle = F.when(style == "system_toggle", said("system", F.when(thinking, "detailed thinking on").otherwise("detailed thinking off")))
    own = F.lit(None).cast(message) if system is None else F.when(system.isNotNull(), said("system", system))
    return F.to_json(
        F.struct(
            model.alias("model"),
            F.array_compact(F.array(toggle, own, said("user", prompt))).alias("messages"),
            max_tokens.alias("max_tokens"),
            F.when(style == "chat_template", F.struct(thinking.alias("enable_thinking"))).alias("chat_template_kwargs"),
            F.when(style == "effort", F.when(thinking, "max").otherwise("low")).alias("reasoning_effort"),
        )
    )


def percent(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("—")).otherwise(F.format_string("%.1f%%", F.bround(x * 100, 1)))


def money(x: Column, prefix: str) -> Column:
    return F.when(x.isNull(), F.lit("—")).when(x < 1, F.concat(F.lit(prefix), F.format_number(x, 4))).otherwise(F.concat(F.lit(prefix), F.format_number(x, 2)))
