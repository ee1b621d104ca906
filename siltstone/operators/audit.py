"""Quality audit, scorecard and validation.

Cell rules depend on the column's name and are chosen on the driver; the rules themselves are expressions over a long
(row, column, value) view, read in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import AUDIT_NULLS, SHORT_NULLS, is_empty, plain_number, trimmed
from .clean import RID, data_columns, duplicates, q

# --- fixed values ---------------------------------------------------------
NUMERIC_WORDS = frozenset("salary price amount cgpa score attendance stock quantity qty pct percent percentage cost turnover revenue sq_ft footfall rate units total_amount unit_price".split())
TEXT_WORDS = frozenset("country name manager manager_name address city state email phone mobile status category type description title code id record_type branch pin pincode pin_code postal postal_code zip zipcode zip_code postcode barcode sku roll_no reg_no".split())
NO_METRIC = frozenset("phone mobile contact tel pin zip postal pincode zipcode postcode id code roll_no reg_no rollno regno serial barcode upc ean asin sku year yy yyyy date dob time timestamp".split())
STOCK = ("stock", "qty", "quantity", "inventory", "units")
MONEY_AUDIT = ("price", "cost", "mrp", "salary", "turnover", "revenue", "rate")
MONEY_CHECK = ("price", "amount", "total", "cost", "salary", "mrp", "rate")
EMAIL_RULE = r"^[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[a-zA-Z]{2,}$"
DATE_WORDS = ("date", "dob", "birth", "timestamp", "datetime", "created_at", "updated_at")
SPAN_WORDS = ("mins", "min", "sec", "second", "hour", "duration", "wait", "prep", "taken", "spent", "elapsed", "avg", "average")
DIMENSIONS = ("missing", "duplicates", "wrong_types", "invalid", "outliers", "format", "record_matching")
FUNDAMENTALS = (
    "Profiling", "Missing values", "Duplicates", "Types", "Text", "Outliers", "Formats", "Validation", "Record matching", "Relationships", "Audit trail", "Quality score",
)
# --------------------------------------------------------------------------


def _words(name: str) -> set[str]:
    return set(re.split(r"[_\s\-]+", name.lower().strip()))


def expects_number(name: str) -> bool:
    n = name.lower().strip()
    text = bool(_words(n) & TEXT_WORDS) or n in TEXT_WORDS or n.endswith(("_id", "_code"))
    return bool(_words(n) & NUMERIC_WORDS) and not text


def is_metric(name: str) -> bool:
    n = name.lower().strip()
    return not (_words(n) & NO_METRIC or n in NO_METRIC or n.endswith(("_id", "_code", "id")))


def cells(df: DataFrame, columns: Sequence[str] | None = None, rid: str = RID) -> DataFrame:
    """(row, column, value) of the cells with a value."""
    cols = data_columns(df) if columns is None else list(columns)
    long = df.select(q(rid).alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in cols])).alias("x")).select("row", "x.*")
    return long.filter(~is_empty(F.col("value"), AUDIT_NULLS))


def _by_column(rules: dict[str, Column]) -> Column:
    """The issue of a cell by its column; null where the column has no rule."""
    out = F.lit(None).cast("string")
    for name, issue in rules.items():
        out = F.when(F.col("column") == name, issue).otherwise(out)
    return out


def missing(df: DataFrame, rid: str = RID) -> DataFrame:
    """(row, column) of every missing cell."""
    cols = data_columns(df)
    long = df.select(q(rid).alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in cols])).alias("x")).select("row", "x.*")
    return long.filter(is_empty(F.col("value"), AUDIT_NULLS)).select("row", "column")


def duplicate_issues(df: DataFrame, rid: str = RID) -> DataFrame:
    """Rows that repeat an earlier one once all cells are trimmed."""
    return duplicates(df.withColumns({c: trimmed(q(c).cast("string")) for c in data_columns(df)}), order=rid)


def wrong_types(df: DataFrame, rid: str = RID) -> DataFrame:
    """Cells that are no number in columns whose name promises one."""
    cols = [c for c in data_columns(df) if expects_number(c)]
    if not cols:
        return cells(df, data_columns(df), rid).limit(0)
    return cells(df, cols, rid).filter(plain_number(F.col("value")).isNull())


def invalid_rule(name: str) -> Column | None:
    n, v = name.lower().strip(), F.col("value")
    num = plain_number(v)
    if "email" in n:
        return F.when(~trimmed(v).rlike(EMAIL_RULE), "email")
    if any(w in n for w in ("attendance", "pct", "percent")):
        return F.when((num < 0) | (num > 100), "percentage")
    if n == "age":
        return F.when((num < 0) | (num > 130), "age")
    if any(w in n for w in STOCK):
        return F.when(num < 0, "negative_stock")
    if any(w in n for w in MONEY_AUDIT):
        return F.when(num < 0, "negative_price")
    return None


def invalid_values(df: DataFrame, rid: str = RID) -> DataFrame:
    """(row, column, value, issue) of cells that break the rule of their column; nothing is changed."""
    rules = {c: r for c in data_columns(df) if (r := invalid_rule(c)) is not None}
    return cells(df, list(rules) or data_columns(df)[:1], rid).withColumn("issue", _by_column(rules)).filter("issue is not null")


def outliers(df: DataFrame, columns: Sequence[str] | None = None, rid: str = RID, least: int = 6) -> DataFrame:
    """(row, column, x, low, high) strictly outside 1.5 interquartile ranges, for columns of ``least`` numbers or more.

    The quartiles are one small row a column (bounded by the width of the table) and are broadcast.
    """
    cols = [c for c in (data_columns(df) if columns is None else columns) if columns is not None or is_metric(c)]
    nums = cells(df, cols, rid).select("row", "column", plain_number(F.col("value")).alias("x")).filter("x is not null")
    fence = nums.groupBy("column").agg(F.count("*").alias("n"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("p")).filter((F.col("n") >= least) & (F.col("p")[1] > F.col("p")[0]))
    iqr = F.col("p")[1] - F.col("p")[0]
    fence = fence.select("column", (F.col("p")[0] - 1.5 * iqr).alias("low"), (F.col("p")[1] + 1.5 * iqr).alias("high"))
    return nums.join(F.broadcast(fence), "column").filter("x < low or x > high").select("row", "column", "x", "low", "high")


def format_issues(df: DataFrame, rid: str = RID) -> DataFrame:
    """Outer white space, else currency or thousands marks (not in text columns), else d/m/y with slashes."""
    v, t = F.col("value"), trimmed(F.col("value"))
    rules = {}
    for c in data_columns(df):
        text = bool(_words(c) & TEXT_WORDS)
        money = F.lit(False) if text else t.rlike(r"^[₹$€£¥]\s*[0-9,.]+$") | t.rlike(r"^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$")
        rules[c] = F.when(v != t, "white_space").when(money, "currency").when(t.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$"), "slash_date")
    return cells(df, None, rid).withColumn("issue", _by_column(rules)).filter("issue is not null")


def audit(df: DataFrame, matching: DataFrame | None = None, rid: str = RID) -> DataFrame:
    """(dimension, issues, checked) for the seven dimensions; ``matching`` holds the record-matching findings."""
    cols = data_columns(df)
    total = df.agg((F.count("*") * len(cols)).alias("c"), F.count("*").alias("r"))
    found = [missing(df, rid), duplicate_issues(df, rid), wrong_types(df, rid), invalid_values(df, rid), outliers(df, rid=rid), format_issues(df, rid)]
    rows = [x.agg(F.count("*").alias("issues")).select(F.lit(d).alias("dimension"), "issues", F.lit(d == "duplicates").alias("by_row")) for d, x in zip(DIMENSIONS, found)]
    pairs = matching.agg(F.count("*").alias("issues")) if matching is not None else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("issues"))
    rows.append(pairs.select(F.lit("record_matching").alias("dimension"), "issues", F.lit(True).alias("by_row")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.join(F.broadcast(total)).select("dimension", "issues", F.when(F.col("by_row"), F.col("r")).otherwise(F.col("c")).alias("checked"))


def merge_audits(audits: Sequence[DataFrame]) -> DataFrame:
    """Audits of several collections added up by dimension."""
    out = audits[0]
    for a in audits[1:]:
        out = out.unionByName(a)
    return out.groupBy("dimension").agg(F.sum("issues").alias("issues"), F.sum("checked").alias("checked"))


def scorecard(audited: DataFrame, actions: dict[str, int] | None = None) -> DataFrame:
    """Twelve rows with issues, actions and status; passed where nothing is open."""
    actions = actions or {}
    of = {"Missing values": "missing", "Duplicates": "duplicates", "Types": "wrong_types", "Validation": "invalid", "Outliers": "outliers", "Formats": "format", "Record matching": "record_matching"}
    spark = audited.sparkSession
    rows = spark.createDataFrame([(i + 1, f, of.get(f, ""), int(actions.get(f, 0))) for i, f in enumerate(FUNDAMENTALS)], "id int, fundamental string, dimension string, actions long")
    out = rows.join(F.broadcast(audited.select("dimension", "issues")), "dimension", "left")  # seven rows.withColumn("issues", F.coalesce("issues", F.lit(0)))
    return out.select("id", "fundamental", "issues", "actions", F.when((F.col("issues") == 0) | (F.col("actions") >= F.col("issues")), "Passed").otherwise("Review").alias("status"))


def cleaning_actions(metrics: DataFrame) -> dict[str, int]:
    """Actions for the scorecard out of the cleaning metrics (one row): what cleaning did about each fundamental."""
    m = metrics.first()
    return {"Missing values": m.nulls_normalized + m.empty_rows, "Duplicates": m.duplicates_removed, "Text": m.cells_trimmed, "Formats": m.cells_trimmed}


def filter_issues(issues: DataFrame, column: str | None = None, text: str | None = None) -> DataFrame:
    """Issues (row, column, ...) of one column, or with a text in any cell, whatever its case."""
    out = issues if column is None else issues.filter(F.lower(F.col("column")) == column.lower())
    if text:
        out = out.filter(F.exists(F.array(*[F.lower(q(c).cast("string")) for c in out.columns]), lambda x: x.contains(text.lower())))
    return out


def coverage(df: DataFrame, canonical: Sequence[str]) -> DataFrame:
    """One row: fields expected, columns that are there, columns with a value, and the share of the expected ones that have one."""
    have = [c for c in canonical if c in df.columns]
    filled = df.agg(*[F.max((~is_empty(q(c).cast("string"), AUDIT_NULLS)).cast("int")).alias(f"f{i}") for i, c in enumerate(have)]) if have else df.agg(F.lit(0).alias("f0"))
    n = sum((F.coalesce(F.col(f"f{i}"), F.lit(0)) for i in range(max(1, len(have)))), F.lit(0))
    return filled.select(F.lit(len(canonical)).alias("expected"), F.lit(len(have)).alias("present"), n.cast("long").alias("filled"), F.round(n / F.lit(max(1, len(canonical))), 4).alias("coverage"))


def quality_score(records: Column, errors: Column) -> Column:
    """D22"""
    return F.round(F.greatest(F.lit(0.0), (records - errors) / records), 4)


def audit_text(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, lines, blank_lines, repeated_lines) of each document; a line repeats if any earlier one is equal, case aside.

    Per document the lines are arrays, so nothing is shuffled; only lines of more than one character count as repeats.
    """
    lines = F.split(F.regexp_replace(q(text), r"\r\n?", "\n"), "\n")
    keys = F.filter(F.transform(lines, lambda x: F.lower(trimmed(x))), lambda x: F.length(x) > 1)
    return docs.filter(q(text).isNotNull()).select(q(doc), F.size(lines).alias("lines"), F.size(F.filter(lines, lambda x: trimmed(x) == "")).alias("blank_lines"), (F.size(keys) - F.size(F.array_distinct(keys))).alias("repeated_lines"))


def check_rule(name: str) -> Column | None:
    """V1: the rule of a column by its name; the first that fits."""
    n = name.lower().strip().replace("-", "_").replace(" ", "_")
    v = trimmed(F.col("value"))
    signed = F.regexp_replace(v, r"[^0-9.-]", "")
    number = F.when(signed.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), signed.try_cast("double"))
    if "email" in n:
        return F.when(~v.rlike(EMAIL_RULE), "email")
    if any(w in n for w in DATE_WORDS) or ("time" in n and not any(w in n for w in SPAN_WORDS)):
        dated = v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}") | v.rlike(r"^[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}")
        return F.when(~v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$") & ((F.length(v) < 4) | ~dated), "date")
    if any(w in n for w in ("phone", "mobile", "contact", "cell")):
        digits = F.length(F.regexp_replace(v, r"[^0-9]", ""))
        return F.when((digits < 7) | (digits > 15), "phone")
    if any(w in n for w in STOCK) and "id" not in n:
        return F.when(number < 0, "negative_stock")
    if any(w in n for w in MONEY_CHECK):
        return F.when(number < 0, "negative_money")
    if any(w in n for w in ("pin", "zip", "postal", "pincode")):
        return F.when(F.length(F.regexp_replace(v, r"\s+", "")) > 10, "postal_code")
    return None


def validate(df: DataFrame, rid: str = RID) -> DataFrame:
    """V1, V3: (row, column, value, issue) of cells that break a rule; rows are kept."""
    rules = {c: r for c in data_columns(df) if (r := check_rule(c)) is not None}
    if not rules:
        return cells(df, data_columns(df)[:1], rid).limit(0).withColumn("issue", F.lit("").cast("string"))
    long = df.select(q(rid).alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in rules])).alias("x")).select("row", "x.*")
    return long.filter(~is_empty(F.col("value"), (*SHORT_NULLS, "-"))).withColumn("issue", _by_column(rules)).filter("issue is not null")


def validate_fields(fields: DataFrame) -> DataFrame:
    """V2: ``fields`` (key, value, type) with ``is_valid``: e-mail form, ISO date, phone of eight digits or more."""
    v = trimmed(F.col("value"))
    ok = F.when(F.col("type") == "email", v.rlike(EMAIL_RULE)).when(F.col("type") == "date", v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")).when(F.col("type") == "phone", F.length(F.regexp_replace(v, r"[^0-9]", "")) >= 8)
    return fields.withColumn("is_valid", F.coalesce(ok, F.lit(True)))
