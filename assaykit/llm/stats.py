"""Statistics of whole texts, computed a few megabytes at a time without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from assaykit.llm.common import coded_words, compact, spaces

SYMBOLS = "#*$%&|<>"
#: The counts first, then shares; all are doubles in a table of statistics.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "mean_word", "distinct_share", "words_per_line", "bar_share", "shout_share", "stop_share")
NAMES = (*COUNTS, *SHARES)

_UPPER, _DIGIT, _MARK, _SHOUT = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _DIGIT
_CLASS[[ord(c) for c in SYMBOLS]] = _MARK
_CLASS[[ord(c) for c in "!?"]] = _SHOUT


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values between one end and the next."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends[1:]] - total[ends[:-1]]


def repeated_windows(codes: np.ndarray, ends: np.ndarray, width: int = 3) -> np.ndarray:
    """Words of each text that lie in a window of `width` words found twice or more in that text."""
    n = len(codes)
    if n < width:
        return np.zeros(len(ends) - 1, np.int64)
    key = codes
    for k in range(1, width):  # each step makes dense codes of one word more
        key = key[: n - k] * (int(codes.max()) + 1) + codes[k:]
        if k < width - 1 and int(key.max(initial=0)) >= 2**62 // (int(codes.max()) + 1):
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    whole = owner[: n - width + 1] == owner[width - 1 :]
    at = np.flatnonzero(whole)
    order = at[np.argsort(key[at], kind="stable")]  # equal windows of a text come side by side
    same = (key[order[1:]] == key[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    for k in range(1, width):
        covered[k:] |= twice[:-k]
    return sums(covered, ends)


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line of the text; lines with a word."""
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines)), len(lines)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text; a null text counts as an empty one, with zeros throughout."""
    texts = compact(texts)
    codes, ends, distinct = coded_words(texts)
    n = np.diff(ends)
    strings = texts.to_pylist()
    lines = np.array([repeated_lines(x) for x in strings], np.int64).reshape(-1, 2)
    chars = np.array([len(x) - spaces(x) for x in strings], np.int64)
    symbols = np.array([sum(map(x.count, SYMBOLS)) for x in strings], np.int64)
    repeats = repeated_windows(codes, ends)

    length = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    kind = _CLASS[data[start[0] : start[-1]]]
    edges = start - start[0]
    upper, digit, mark, shout = (sums(kind == k, edges) for k in (_UPPER, _DIGIT, _MARK, _SHOUT))
    bars = np.array([x.count("|") for x in strings], np.int64)

    owner = np.repeat(np.arange(len(n)), n)
    seen = np.unique(owner * max(1, len(distinct)) + codes)
    different = np.bincount(seen // max(1, len(distinct)), minlength=len(n)) if len(seen) else np.zeros(len(n), np.int64)
    short = sums((pc.utf8_length(distinct).to_numpy(zero_copy_only=False) <= 3)[codes], ends) if len(distinct) else np.zeros(len(n), np.int64)

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    return np.column_stack(
        [n, chars, symbols, lines[:, 0], repeats]
        + [share(symbols, chars), share(lines[:, 0], lines[:, 1]), share(repeats, n), share(upper, length), share(digit, length), share(mark, length)]
        + [share(chars, n), share(different, n), share(n, lines[:, 1]), share(bars, n), share(shout, n), share(short, n)]
    ).astype(float)
