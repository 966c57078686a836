"""Regular expressions with Python's meaning, and matches with their places."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str, flags: str = "") -> str:
    """A pattern for Java: Unicode classes, and line feeds alone end lines."""
    return f"(?Ud{flags}){pattern}"


_ASCII_WORD = "(?-iu:[0-9A-Za-z_])"
ASCII_EDGE = f"(?:(?<!{_ASCII_WORD})(?={_ASCII_WORD})|(?<={_ASCII_WORD})(?!{_ASCII_WORD}))"
#: Classes as RE2 has them, which SQL's engine uses.
_ASCII = {"s": r"\t\n\f\r ", "d": "0-9", "w": "0-9A-Za-z_"}
#: What RE2 takes, without regard to case, for ASCII's letters.
_KIN = {"s": "\u017f", "k": "\u212a"}


def ascii_rx(pattern: str) -> str:
    """A pattern of rx as RE2 reads it: its classes and word ends are ASCII's, and of other letters s and k alone have kin."""
    head = re.match(r"(?:\(\?[A-Za-z]+\))*", pattern)[0]
    flags = "".join(x for x in "is" if x in head)
    out, within = [], False
    for part in re.findall(r"(?s)\\p\{\w+\}|\\.|.", pattern[len(head) :]):
        kin = _KIN.get(part.lower()) if "i" in flags else None
        if part[0] == "\\" and part[1].lower() in _ASCII:
            part = _ASCII[part[1]] if within else f"[{'^' if part[1].isupper() else ''}{_ASCII[part[1].lower()]}]"
        elif part == r"\b":
            part = ASCII_EDGE
        elif kin:
            part = part + kin if within else f"[{part}{kin}]"
        within = part == "[" or within and part != "]"
        out.append(part)
    return f"(?d{flags}){''.join(out)}"


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once however often use names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group, or null."""
    return once(F.regexp_extract(text, pattern, group), lambda x: F.when(x != "", x))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def squeeze(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, rx(r"\s+"), " "), "^ | $", "")


def tokens(text: Column) -> Column:
    """Words between white space; a blank text has none."""
    return once(squeeze(text), lambda flat: F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " ")))


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def places(text: Column, pattern: str) -> Column:
    """Matches in order as (start from 0, match): pieces between them tell where they stand."""
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        return F.struct((start + F.length(x["match"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), x["match"].alias("match")))).alias("out"))

    matches = every(text, pattern)
    named = F.zip_with(F.split(text, pattern, -1), matches, lambda piece, match: F.struct(piece.alias("piece"), match.alias("match")))
    named = F.filter(named, lambda x: x["match"].isNotNull())  # the last piece has no match after it
    return F.aggregate(named, begun, step, lambda acc: acc["out"])


def one_of(values) -> str:
    return "|".join(values)


def trie(words) -> str:
    """A pattern for the longest of some words that stands at a place: shared beginnings are tried once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(h) + trie(rest) for h, rest in sorted(heads.items())]
    whole = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    if not parts:
        return ""
    return f"(?:{whole})?" if "" in words else whole
