"""E-mail and phone forms that two records can be compared by."""

from __future__ import annotations

import re

from ..config import CLEAN_NULLS
from .strings import fold

_NULLS = frozenset(CLEAN_NULLS)


def filled(s: str | None) -> str:
    """Trimmed text, "" for a null token."""
    s = (s or "").strip()
    return "" if s.lower() in _NULLS else s


def mailbox(raw: str | None) -> str:
    """Local part, folded, without tag and decoration; "" where there is none."""
    s = filled(raw)
    if not s:
        return ""
    s = re.sub(r"\s*[\(\[]\s*at\s*[\)\]]\s*|\s+at\s+", "@", fold(s))
    s = re.sub(r"^(?:mailto:|e-?mail:|[<\"'\s])+", "", s)
    local = s.partition("@")[0] if "@" in s else ""
    return re.sub(r"[^a-z0-9._\-]", "", local.partition("+")[0])


def subscriber(raw: str | None) -> str:
    """Last ten digits of a phone; "" for null tokens, shorter numbers and dummies."""
    s = re.sub(r"\.0$", "", filled(raw))
    d = re.sub(r"\D", "", s)[-10:]
    return d if len(d) == 10 and len(set(d)) > 1 and d != "1234567890" else ""
