"""Scalar operators: ``Column -> Column`` expressions that stay inside generated code.

Every function maps null to null unless it says otherwise, and never raises: texts that can't be read give null, or the value
itself where the standardiser keeps what it can't parse.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
#: Null words differ by operator; all are compared trimmed and lower-cased.
AUDIT_NULLS = ("", "null", "none", "nan", "nat", "n/a", "na", "nil", "undefined", "-", "--", "#n/a", "unknown", "missing", "not available")
MATCH_NULLS = ("", "null", "none", "nan", "nat", "n/a", "na", "nil", "undefined", "-", "--", "#n/a", "unknown")
SHORT_NULLS = ("", "none", "null", "nan", "n/a")
#: Texts that a CSV reader of the pandas family takes for missing.
CSV_NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
TRUE_WORDS = ("true", "yes", "y", "1", "t", "active", "in_stock", "in stock", "available", "open", "enabled")
FALSE_WORDS = ("false", "no", "n", "0", "f", "inactive", "out_of_stock", "out of stock", "unavailable", "closed", "disabled")
STREET_WORDS = (("st", "street"), ("ave", "avenue"), ("rd", "road"), ("blvd", "boulevard"), ("dr", "drive"), ("ln", "lane"), ("apt", "apartment"), ("ste", "suite"), ("fl", "floor"))
DOMAINS = {
    "customer": ("customer", "client", "user", "buyer", "member"),
    "store": ("store", "branch", "outlet", "warehouse", "shop"),
    "product": ("item", "product", "sku", "goods", "merchandise"),
    "transaction": ("transaction", "sales", "order", "invoice", "receipt", "purchase"),
    "car": ("car", "vehicle", "auto", "automotive"),
    "student": ("student", "academic", "course", "syllabus", "education"),
    "employee": ("employee", "staff", "hr"),
    "medical": ("medical", "patient", "healthcare", "hospital", "doctor"),
}
#: Substring hits follow this order.
FIELD_WEIGHTS = (
    (1.0, ("id", "customer_id", "store_id", "item_id", "product_id", "sku", "barcode", "upc", "ean", "asin", "branch_id", "outlet_id")),
    (0.85, ("email", "phone", "mobile", "contact", "store_email", "customer_email", "customer_phone")),
    (0.6, ("name", "full_name", "first_name", "last_name", "store_name", "product_name", "item_name", "address", "street", "location", "manager")),
    (0.3, ("city", "state", "pin", "pin_code", "zip_code", "postal_code")),
    (0.2, ("country",)),
    (0.3, ("category", "brand", "department")),
    (0.2, ("gender", "status")),
)
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# --------------------------------------------------------------------------
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    """White space collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


normalize_text = squeezed


def is_empty(c: Column, words: Iterable[str] = MATCH_NULLS) -> Column:
    """Null, or one of the operator's null words."""
    return c.isNull() | F.lower(trimmed(c)).isin(*words)


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))


def title_words(c: Column) -> Column:
    return F.array_join(F.transform(F.split(squeezed(c), " "), _capital), " ")


def normalize_name(c: Column) -> Column:
    """Words capitalised, each part around an apostrophe by itself, ``Mc`` followed by a capital."""

    def word(w: Column) -> Column:
        mc = F.lower(w).startswith("mc") & (F.length(w) > 2)
        apostrophe = F.array_join(F.transform(F.split(w, "'"), _capital), "'")
        return F.when(w.contains("'"), apostrophe).when(mc, F.concat(F.lit("Mc"), _capital(F.substring(w, 3, 1 << 20)))).otherwise(_capital(w))

    s = squeezed(c)
    return F.when(s != "", F.array_join(F.transform(F.split(s, " "), word), " "))


def normalize_city(c: Column) -> Column:
    """S2"""
    return F.when(~is_empty(c, SHORT_NULLS), title_words(c))


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), 0)


def parse_date(c: Column, dayfirst_iso: bool = False) -> Column:
    """S3: a date as ISO text, null if unreadable or outside 1900-2100.

    Year first is read as ISO (``dayfirst_iso`` swaps day and month where both are at most 12, as day-first parsers do);
    otherwise the day comes first unless that gives no date. Years of two digits from 70 on are 1970 to 1999.
    """
    iso, dmy = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ].*)?$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$"
    text = r"^(\d{1,2})(?:st|nd|rd|th)?[ -]+([A-Za-z]{3})[a-z]*\.?,?[ -]+(\d{4})$"
    month_first = r"^([A-Za-z]{3})[a-z]*\.?[ -]+(\d{1,2})(?:st|nd|rd|th)?,?[ -]+(\d{4})$"
    months = F.array(*[F.lit(m) for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")])

    def written(y: Column, m: Column, d: Column) -> Column:
        last = F.when(m.isin(4, 6, 9, 11), 30).when(m != 2, 31).when((y % 4 != 0) | ((y % 100 == 0) & (y % 400 != 0)), 28).otherwise(29)
        return F.when(y.between(1900, 2100) & m.between(1, 12) & (d >= 1) & (d <= last), F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))

    def read(s: Column) -> Column:
        def found(pattern: str, form: Callable[[Column], Column]) -> Column:
            groups = F.array(*[F.regexp_extract(s, pattern, k) for k in (1, 2, 3)])
            return F.when(s.rlike(pattern), bind(groups, form))

        num = lambda g, k: g[k].try_cast("int")
        month = lambda g, k: F.array_position(months, F.lower(g[k])).cast("int")
        year = lambda g, k: num(g, k) + F.when(F.length(g[k]) > 2, 0).when(num(g, k) >= 70, 1900).otherwise(2000)
        forward = lambda g: written(num(g, 0), num(g, 1), num(g, 2))
        swapped = lambda g: written(num(g, 0), num(g, 2), num(g, 1))
        first = found(iso, lambda g: F.coalesce(*((swapped(g), forward(g)) if dayfirst_iso else (forward(g), swapped(g)))))
        numeric = found(dmy, lambda g: F.coalesce(written(year(g, 2), num(g, 1), num(g, 0)), written(year(g, 2), num(g, 0), num(g, 1))))
        worded = found(text, lambda g: written(num(g, 2), month(g, 1), num(g, 0)))
        named = found(month_first, lambda g: written(num(g, 2), month(g, 0), num(g, 1)))
        return F.when(F.length(s) >= 4, F.coalesce(first, numeric, worded, named))

    return bind(trimmed(c), read)


def standardize_date(c: Column, dayfirst_iso: bool = False) -> Column:
    """S3 without a time part."""
    return parse_date(F.regexp_replace(trimmed(c), r"[T ]\d{1,2}:\d{2}.*$", ""), dayfirst_iso)


def normalize_email(c: Column) -> Column:
    """The first address in the text, lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(c, EMAIL, 0)), F.lit(""))


def normalize_phone(c: Column, country: str = "91") -> Column:
    """E.164. With ``+`` or ``00`` the number is international; ten digits, or eleven with a leading 0, get ``country``."""
    s = F.regexp_replace(trimmed(c), r"\.0+$", "")
    d = F.regexp_replace(s, r"\D", "")
    n = F.length(d)
    foreign = s.startswith("+") | s.startswith("00")
    bare = F.regexp_replace(d, "^00", "")
    return (
        F.when(foreign & F.length(bare).between(8, 15), F.concat(F.lit("+"), bare))
        .when(n == 10, F.concat(F.lit(f"+{country}"), d))
        .when((n == 11) & d.startswith("0"), F.concat(F.lit(f"+{country}"), F.substring(d, 2, 10)))
        .when(n.between(11, 15), F.concat(F.lit("+"), d))
    )


def plain_number(c: Column) -> Column:
    """Currency marks, commas, blanks and per cent removed, then a number; null unless all of it is one."""
    s = F.regexp_replace(c, r"[₹$€£¥,\s%]", "")
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def normalize_number(c: Column) -> Column:
    """Also without currency codes (Rs, INR, USD, EUR, GBP); rounded to four places."""
    s = F.regexp_replace(F.regexp_replace(c, r"(?i)\b(inr|usd|eur|gbp|rs)\b\.?", ""), r"[₹$€£¥,\s]", "")
    return F.when(s.rlike(NUMBER), F.round(s.try_cast("double"), 4))


def normalize_postal(c: Column) -> Column:
    """S7"""
    s = F.regexp_replace(F.regexp_replace(trimmed(c), r"\.0+$", ""), r"\s+", "")
    return F.when(F.length(s).between(1, 10), s)


def standardize_boolean(c: Column) -> Column:
    """``true`` or ``false``; other values stay as they are."""
    t = F.lower(trimmed(c))
    return F.when(t.isin(*TRUE_WORDS), F.lit("true")).when(t.isin(*FALSE_WORDS), F.lit("false")).otherwise(c)


def standardize_id(c: Column) -> Column:
    """S10"""
    s = F.regexp_replace(trimmed(c), r"\.0+$", "")
    return F.when(is_empty(c, SHORT_NULLS), None).when(s.rlike(r"^[a-zA-Z]+[-\s_]?\d+$"), F.upper(s)).otherwise(s)


def standardize_state(c: Column) -> Column:
    """S11"""
    s = squeezed(c)
    return F.when(F.length(s) == 2, F.upper(s)).otherwise(normalize_name(s))


def remove_control(c: Column) -> Column:
    """Control and format characters out, line breaks and tabs kept."""
    return F.regexp_replace(c, r"[\p{C}&&[^\n\r\t]]", "")


def plain_quotes(c: Column) -> Column:
    """S14 without NFKC: typographic quotes and dashes, hard blanks and byte-order marks."""
    return F.translate(c, "‘’‚“”„–—−   ﻿", "'''\"\"\"---   ")


def fix_ocr(c: Column) -> Column:
    """No blank before ``: , . ;``, one after ``word:`` unless a slash or blank follows."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+([:,.;])", "$1"), r"(\w):(?=[^\s/])", "$1: ")


def normalize_lines(c: Column) -> Column:
    """LF line ends, blanks collapsed, lines trimmed, at most one blank line in a row."""
    lines = F.transform(F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    kept = F.filter(lines, lambda x, i: (x != "") | (i == 0) | (F.get(lines, i - 1) != ""))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def drop_repeated_lines(c: Column) -> Column:
    """A line equal to the one before it is dropped; blank lines stay."""
    lines = F.split(c, "\n")
    return F.array_join(F.filter(lines, lambda x, i: (F.trim(x) == "") | (i == 0) | (F.get(lines, i - 1) != x)), "\n")


def dedupe_phrases(c: Column) -> Column:
    """``X and X`` becomes ``X``; a sentence that repeats an earlier one, whatever its case, is dropped."""
    once = F.regexp_replace(squeezed(c), r"(?i)^(.+?)\s+and\s+\1(?:\.|\s*)$", "$1")
    parts = F.filter(F.split(once, r"(?<=[.!?])\s+"), lambda x: x != "")
    low = lambda ps: F.transform(ps, lambda y: F.lower(F.regexp_replace(y, r"[.!?]+$", "")))
    first = bind(parts, lambda ps: bind(low(ps), lambda ls: F.filter(ps, lambda x, i: F.array_position(ls, F.get(ls, i)) == i + 1)))
    return F.array_join(first, " ")


def match_form(c: Column) -> Column:
    """Form that records are compared in."""
    s = F.regexp_replace(F.lower(trimmed(c)), r"\.0$", "")
    return squeezed(F.regexp_replace(s, r"[,;.\-_]", " "))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def suffix_mark(c: Column) -> Column:
    """Trailing single letter, number or run of i, v, x that tells namesakes apart; "" where there is none."""
    return F.regexp_extract(F.lower(trimmed(c)), r"\b([a-z]|[0-9]+|[ivx]+)$", 1)


def string_similarity(a: Column, b: Column) -> Column:
    """S24, on texts in match form."""
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda e: _similarity(e["a"], e["b"]))


def _similarity(a: Column, b: Column) -> Column:
    sa, sb = suffix_mark(a), suffix_mark(b)
    ta, tb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    jac = F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(F.array_union(ta, tb)), F.lit(1))
    ratio = levenshtein_ratio(a, b)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    # a leading initial before a name that is otherwise equal
    behind = lambda x: F.when((F.size(F.split(x, " ")) > 1) & (F.instr(x, " ") == 2), F.substring(x, F.lit(3), F.length(x)))
    initial = F.coalesce(behind(a) == b, F.lit(False)) | F.coalesce(behind(b) == a, F.lit(False))
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when((sa != "") & (sb != "") & (sa != sb), 0.2)
        .when(initial, 0.92)
        .when(ratio >= 0.75, ratio)
        .when(jac >= 0.7, F.least(F.lit(0.95), 0.7 + 0.25 * jac))
        .when((a.contains(b) | b.contains(a)) & (short / long >= 0.8), 0.85)
        .otherwise(ratio)
    )


def field_weight(name: str) -> float:
    """Weight of a column by its name: the name itself, else the first listed name that holds it or that it holds."""
    clean = name.strip().lower().replace("-", "_").replace(" ", "_")
    listed = [(k, w) for w, keys in FIELD_WEIGHTS for k in keys]
    return dict(listed).get(clean) or next((w for k, w in listed if k in clean or clean in k), 0.5)


def normalize_address(c: Column) -> Column:
    """S27"""
    s = reduce(lambda x, w: F.regexp_replace(x, rf"\b{w[0]}\b", w[1]), STREET_WORDS, F.lower(trimmed(c)))
    return squeezed(F.regexp_replace(s, r"[^\p{L}\p{N}_\s]", " "))


def domain_of(name: str | None) -> str:
    """S28"""
    d = (name or "general").lower().strip()
    return next((k for k, words in DOMAINS.items() if d in words), "general")


def row_identity(columns: list[str]) -> Column:
    """``ID (Name)``, the one there is, or the first value of the row."""
    low = {c: c.lower() for c in columns}
    filled = lambda c: F.when(~is_empty(F.col(f"`{c}`").cast("string"), AUDIT_NULLS), trimmed(F.col(f"`{c}`").cast("string")))
    ids = [c for c in columns if low[c] == "id" or low[c].endswith("_id") or low[c] in ("sku", "vin", "roll_no")]
    names = [c for c in columns if "name" in low[c] or low[c] == "title"]
    i = F.coalesce(*map(filled, ids)) if ids else F.lit(None).cast("string")
    n = F.coalesce(*map(filled, names)) if names else F.lit(None).cast("string")
    rest = F.coalesce(*map(filled, columns), F.lit(""))
    return F.when(i.isNotNull() & n.isNotNull(), F.concat(i, F.lit(" ("), n, F.lit(")"))).otherwise(F.coalesce(i, n, rest))


def display_value(c: Column) -> Column:
    """Part of S30: white space collapsed, whole numbers without their zeros."""
    return squeezed(F.regexp_replace(trimmed(c), r"^(\d+)\.0+$", "$1"))


def base_name(c: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def header_token(name: str) -> str:
    """S32"""
    import re

    return re.sub(r"[\s\-.]+", "_", name.strip().lower())
