"""Normalised link keys of stored customer records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import blank_or_null


def id_key(c: Column) -> Column:
    """Letters (any case) and digits of an id; null where it is a null token or holds neither."""
    key = F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""))
    return F.when(~blank_or_null(c) & (key != ""), key)


def phone_key(c: Column) -> Column:
    """Last ten digits of a phone; null for null tokens, shorter numbers and dummies (one digit repeated, 1234567890)."""
    last = F.right(F.regexp_replace(c, r"[^0-9]", ""), F.lit(10))
    return F.when(~blank_or_null(c) & (F.length(last) == 10) & ~last.rlike(r"^(\d)\1{9}$") & (last != "1234567890"), last)
