"""Plain-Python string helpers that run inside Arrow batches."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# --- fixed values ---------------------------------------------------------
_LETTERS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th", "’": "'", "`": "'", "–": "-", "—": "-"})
_DIGIT_AS_LETTER = str.maketrans({"0": "o", "1": "l", "5": "s", "8": "b"})
# --------------------------------------------------------------------------


def fold(s: str) -> str:
    """Lower case without accents."""
    s = s.lower()
    if s.isascii():
        return s
    s = unicodedata.normalize("NFKD", s.translate(_LETTERS))
    return "".join(c for c in s if not unicodedata.combining(c)).translate(_LETTERS)


def unscan(token: str) -> str:
    """Digits that a scanner read for letters, inside a word."""
    return token.translate(_DIGIT_AS_LETTER)


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int) -> int:
    """Damerau (adjacent swaps) edit distance, or ``most + 1`` where it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = row, before, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def allowed(n: int) -> int:
    """Typing errors tolerated in a word of ``n`` letters."""
    return 0 if n < 4 else 1 if n < 6 else 2


def alike(a: str, b: str) -> bool:
    return a == b or edits(a, b, k := allowed(min(len(a), len(b)))) <= k
