"""Column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import AUDIT_NULLS, is_empty, plain_number
from .clean import data_columns, q

# --- fixed values ---------------------------------------------------------
MONEY = ("price", "amount", "total", "cost", "salary", "income", "mrp", "revenue")
SAMPLE = 100
# --------------------------------------------------------------------------


def long_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value) of every cell as text: one pass over the frame, whatever its width."""
    cols = data_columns(df) if columns is None else list(columns)
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in cols])).alias("x")).select("x.*")


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Total, nulls, share of nulls and distinct values of each column; one row a column.

    Values are counted before columns are, so that a column with one hot value is reduced on the map side.
    """
    empty = is_empty(F.col("value"), AUDIT_NULLS)
    by_value = long_cells(df, columns).groupBy("column", F.when(~empty, F.col("value")).alias("value")).agg(F.count("*").alias("n"))
    out = by_value.groupBy("column").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct_values"))
    return out.withColumn("null_percent", F.round(F.col("nulls") * 100.0 / F.col("total"), 2))


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum and quartiles (linear interpolation) of the numbers of each column, currency marks removed.

    Exact percentiles merge counts of distinct values; a column of very many distinct numbers wants ``approx_stats``.
    """
    nums = long_cells(df, columns).select("column", plain_number(F.col("value")).alias("x")).filter("x is not null")
    return nums.groupBy("column").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p")).select("column", "min", "max", *[F.round(F.col("p")[i], 2).alias(f"q{i + 1}") for i in range(3)])


def approx_stats(df: DataFrame, columns: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """As D2 with mergeable sketches of fixed size instead of exact quartiles."""
    nums = long_cells(df, columns).select("column", plain_number(F.col("value")).alias("x")).filter("x is not null")
    return nums.groupBy("column").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.percentile_approx("x", [0.25, 0.5, 0.75], accuracy).alias("p")).select("column", "min", "max", *[F.col("p")[i].alias(f"q{i + 1}") for i in range(3)])


def text_range(c: Column) -> tuple[Column, Column]:
    """D3: least and greatest text of eight characters or more."""
    t = F.when(F.length(c) >= 8, c)
    return F.min(t), F.max(t)


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of each column; ties by value."""
    counts = long_cells(df, columns).filter(~is_empty(F.col("value"), AUDIT_NULLS)).groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def inconsistent_case(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of values of each column that are spelled in more than one case."""
    spellings = long_cells(df, columns).filter(~is_empty(F.col("value"), AUDIT_NULLS)).select("column", "value").distinct()
    groups = spellings.groupBy("column", F.lower("value").alias("v")).agg(F.count("*").alias("n"))
    return groups.groupBy("column").agg(F.sum((F.col("n") > 1).cast("long")).alias("groups"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows and how many repeat an earlier one."""
    return df.groupBy(*[q(c) for c in data_columns(df)]).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def completeness(df: DataFrame) -> DataFrame:
    """Per cent of cells with a value."""
    cols = data_columns(df)
    missing = sum((F.sum(is_empty(q(c).cast("string"), AUDIT_NULLS).cast("long")) for c in cols), F.lit(0))
    cells = F.count("*") * len(cols)
    return df.agg(F.round((cells - missing) * 100.0 / cells, 2).alias("completeness"))


def infer_types(df: DataFrame, sample: int = SAMPLE) -> dict[str, str]:
    """Type of each column: by name, else from its first ``sample`` values (a bounded sample on the driver)."""
    out: dict[str, str] = {}
    ask = []
    for c in data_columns(df):
        n = c.strip().lower().replace(" ", "_").replace("-", "_")
        if n == "id" or n.endswith("id") or n in ("sku", "vin", "barcode", "roll_no"):
            out[c] = "identifier"
        elif "email" in n or n == "mail":
            out[c] = "email"
        elif any(w in n for w in ("phone", "mobile", "tel", "contact")):
            out[c] = "phone"
        elif "date" in n or n in ("dob", "timestamp", "created_at"):
            out[c] = "date"
        elif any(w in n for w in ("zip", "postal", "pin")):
            out[c] = "postal_code"
        else:
            ask.append(c)
    if not ask:
        return out
    rows = df.count()
    for c in ask:
        v = [r[0] for r in df.select(q(c).cast("string")).filter(~is_empty(q(c).cast("string"), AUDIT_NULLS)).limit(sample).collect()]
        low = [x.strip().lower() for x in v]
        numbers = [x for x in low if _is_number(x)]
        if not v:
            out[c] = "unknown"
        elif len(set(low)) <= 4 and sum(x in ("true", "false", "yes", "no", "0", "1", "y", "n", "active", "inactive") for x in low) >= 0.8 * len(low):
            out[c] = "boolean"
        elif len(numbers) >= 0.8 * len(low):
            money = any(w in c.lower() for w in MONEY)
            out[c] = "float" if money or any("." in x for x in numbers) else "integer"
        else:
            out[c] = "categorical" if len(set(low)) < 15 and rows > 30 else "string"
    return out


def _is_number(s: str) -> bool:
    import re

    return re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", re.sub(r"[₹$€£¥,\s%]", "", s)) is not None
