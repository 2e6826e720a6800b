"""Figures of a text that the quality rules and the classifier use."""

from __future__ import annotations

import re
import numpy as np

_SPACE_IN_TEXT = re.compile("[\x20\x09-\x0d]")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_STRIP = " \t\n\x0b\x0c\r"


def base(text: str | None) -> tuple[int, int, int, int, int, list[bytes]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words) of a whole text."""
    text = text or ""
    w = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - len(_SPACE_IN_TEXT.findall(text)) if w else 0
    symbols = len(_SYMBOLS.findall(text))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_STRIP):
            seen.add(line)
    return len(w), chars, symbols, dup, repeats(w), w


def repeats(w: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more, the first included."""
    n = len(w)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, n)
    v = len(number)
    if v < 1 << 21:
        key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # numbered pairs keep the key below 2^63
        pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * v + ids[2:]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1)
    hit = np.zeros(n, bool)
    for i in range(3):
        hit[at + i] = True
    return int(hit.sum())


#: Names of the figures of ``statistics``.
NAMES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct", "shouts", "line_words", "long_words", "ends"]


def statistics(text: str | None, known: tuple | None = None) -> list[float]:
    """Rule statistics as rates, so that long and short texts compare."""
    text = text or ""
    n, chars, symbols, dup, rep, w = known or base(text)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    m = max(1, len(data))
    kind = np.bincount(data, minlength=256) if len(data) else np.zeros(256, np.int64)
    upper, digits = kind[65:91].sum(), kind[48:58].sum()
    marks = kind[33:48].sum() + kind[58:65].sum() + kind[91:97].sum() + kind[123:127].sum()
    lines = int(kind[10]) + 1
    k = max(1, n)
    shout = sum(x.isupper() and len(x) > 1 for x in w)
    long = sum(len(x) > 15 for x in w)
    ends = int(kind[46] + kind[33] + kind[63])
    return [float(np.log1p(n)), chars / k, symbols / m, dup / lines, rep / k, upper / m, digits / m, marks / m, len(set(w)) / k ** 0.75, shout / k, float(np.log1p(n / lines)), long / k, ends / k]
