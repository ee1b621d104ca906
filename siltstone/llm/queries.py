"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import p10_sentences, p1_entities, p2_addresses, p3_components, p4_neighbours, p5_names, p6_survivor, p7_canonical, p8_packing, p9_mixing

_MODULES = (p10_sentences, p1_entities, p2_addresses, p3_components, p4_neighbours, p5_names, p6_survivor, p7_canonical, p8_packing, p9_mixing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for m in _MODULES for n, f in vars(m).items() if n[:1] == "p" and n[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in _MODULES if hasattr(m, "oracle") for n, s in m.oracle().items()}
