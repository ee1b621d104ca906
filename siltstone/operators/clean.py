"""Cleaning of tables: headers, null words, white space, empty rows and columns, repeated rows, provenance.

Frames keep all cells as text and a hidden ``_rid`` with the source order, as "the first one wins" needs an order.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CLEAN_NULLS
from ..functions.scalars import trimmed

RID = "_rid"


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def q(name: str) -> Column:
    """Column of that very name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def clean_headers(names: Sequence[str]) -> list[str]:
    """B1: trimmed, blanks collapsed, empty ones called "Column", repeats numbered ``_1, _2``."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        n = re.sub(r"\s+", " ", str(n)).strip() or "Column"
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}_{k}" if k else n)
    return out


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text: arrays, maps and structs as JSON, the rest as Spark writes it."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[(F.to_json(q(f.name)) if isinstance(f.dataType, nested) else q(f.name) if f.name == RID else q(f.name).cast("string")).alias(f.name) for f in df.schema.fields])


def blank_row(columns: Sequence[str]) -> Column:
    """B2: nothing but nulls and blank text."""
    return ~F.exists(F.array(*[q(c) for c in columns]), lambda x: x.isNotNull() & (trimmed(x) != ""))


def clean_cell(c: Column) -> Column:
    """Trimmed; null for blanks and null words. Numbers stay as written, negatives too."""
    t = trimmed(c)
    return F.when((t != "") & ~F.lower(t).isin(*CLEAN_NULLS), t)


def clean_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = data_columns(df) if columns is None else list(columns)
    return df.withColumns({c: clean_cell(q(c)) for c in cols}) if cols else df


def drop_empty_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = data_columns(df) if columns is None else list(columns)
    return df.filter(~blank_row(cols)) if cols else df


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Columns without a value go, if any column has one. One aggregate over the frame decides."""
    cols = data_columns(df)
    if not cols:
        return df
    filled = df.agg(*[F.max(clean_cell(q(c).cast("string")).isNotNull()).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    keep = [c for i, c in enumerate(cols) if filled[i]]
    return df.drop(*[f"{c}" for c in cols if c not in keep]) if keep else df


def keep_first(df: DataFrame, keys: Sequence[str] | None = None, order: str = RID) -> DataFrame:
    """The first row of each group of equal keys; nulls are equal.

    A minimum over (order, rest of the row) is reduced before the shuffle, so a hot key is no hot task.
    """
    keys = data_columns(df) if keys is None else list(keys)
    first = df.groupBy(*[q(k) for k in keys]).agg(F.min(F.struct(q(order), *[q(c) for c in df.columns if c not in keys and c != order])).alias("_f"))
    return first.select(*[q(c) if c in keys else F.col("_f").getField(c).alias(c) for c in df.columns])


def duplicates(df: DataFrame, keys: Sequence[str] | None = None, order: str = RID) -> DataFrame:
    """Rows that repeat an earlier one."""
    keys = data_columns(df) if keys is None else list(keys)
    first = df.groupBy(*[q(k) for k in keys]).agg(F.min(q(order)).alias(order)).select(order)
    return df.join(first, order, "left_anti")


def provenance(df: DataFrame, limit: int | None = 100, columns: Sequence[str] | None = None) -> DataFrame:
    """(row, column, original, cleaned, operation, rule) of each change of a cell, the first ``limit`` in source order."""
    cols = data_columns(df) if columns is None else list(columns)
    long = df.select(F.col(RID).alias("row"), F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), q(c).alias("original")) for i, c in enumerate(cols)])).alias("x")).select("row", "x.*")
    t, v = trimmed(F.col("original")), clean_cell(F.col("original"))
    steps = F.array(
        F.when(F.col("original") != t, F.struct(F.lit(0).alias("step"), F.lit("trim").alias("operation"), t.alias("cleaned"), F.lit("outer white space").alias("rule"))),
        F.when(F.col("original").isNotNull() & v.isNull(), F.struct(F.lit(1).alias("step"), F.lit("null").alias("operation"), F.lit(None).cast("string").alias("cleaned"), F.lit("null word").alias("rule"))),
    )
    log = long.select("row", "pos", "column", "original", F.explode(F.array_compact(steps)).alias("s")).select("row", "pos", "column", "original", "s.*").orderBy("row", "pos", "step")
    return (log.limit(limit) if limit is not None else log).drop("pos", "step")


def clean_table(df: DataFrame) -> DataFrame:
    """B1-B3, B5, E1 in their order; keeps ``_rid``."""
    heads = iter(clean_headers([c for c in df.columns if c != RID]))
    df = df.toDF(*[RID if c == RID else next(heads) for c in df.columns])
    return drop_empty_columns(keep_first(drop_empty_rows(clean_cells(drop_empty_rows(as_text(df))))))


def cleaning_metrics(df: DataFrame) -> DataFrame:
    """One row of counts over the raw frame (text cells and ``_rid``)."""
    cols = data_columns(df)
    cells = F.array(*[q(c) for c in cols])
    nulled = F.size(F.filter(cells, lambda x: x.isNotNull() & clean_cell(x).isNull()))
    trims = F.size(F.filter(cells, lambda x: x != trimmed(x)))
    blank = blank_row(cols)
    cleaned = clean_cells(df.filter(~blank_row(cols)))
    rows = drop_empty_rows(cleaned)
    distinct = rows.groupBy(*[q(c) for c in cols]).agg(F.count("*").alias("n"))
    left = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("filled_rows"), F.count("*").alias("final_rows"))
    base = df.agg(F.count("*").alias("initial_rows"), F.coalesce(F.sum(blank.cast("long")), F.lit(0)).alias("blank_rows"), F.coalesce(F.sum(F.when(~blank, nulled)), F.lit(0)).alias("nulls_normalized"), F.coalesce(F.sum(F.when(~blank, trims)), F.lit(0)).alias("cells_trimmed"))
    return base.join(left).select("initial_rows", "final_rows", (F.col("initial_rows") - F.col("filled_rows")).alias("empty_rows"), (F.col("filled_rows") - F.col("final_rows")).alias("duplicates_removed"), "nulls_normalized", "cells_trimmed")


def union_collections(frames: dict[str, DataFrame], tag: str | None = None) -> DataFrame:
    """H1, H2: bag union over all columns, missing ones null; ``tag`` names the collection of each row."""
    out = None
    for name, df in frames.items():
        df = df.withColumn(tag, F.lit(name)) if tag else df
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no collections")
    return out


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows with a cell that holds ``text``, whatever its case."""
    cols = data_columns(df)
    return df.filter(F.exists(F.array(*[F.lower(q(c).cast("string")) for c in cols]), lambda x: x.contains(text.lower())))


def populated_columns(df: DataFrame) -> DataFrame:
    """Hidden, raw and empty columns out."""
    return drop_empty_columns(df.select(*[q(c) for c in data_columns(df) if c.lower() != "raw_text"]))


def page(df: DataFrame, number: int, size: int = 10, order: str = RID) -> DataFrame:
    """Page ``number``, from 1."""
    return df.orderBy(order).offset(size * (max(1, number) - 1)).limit(size)


def first_rows(df: DataFrame, per: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; limited per partition before the shuffle."""
    w = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
