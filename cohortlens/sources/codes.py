"""Bringing device codes from different sites onto one vocabulary (A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.plans.skew import lookup_join


def harmonize_codes(df: DataFrame, mapping: DataFrame, code: str, canonical: str = "canonical") -> DataFrame:
    """Add ``canonical`` for each code, plus an ``is_mapped`` flag; unmapped codes stay as they are.

    ``mapping`` has columns ``code`` and ``canonical``; of several rows for a code the least
    canonical code counts, so that no row of ``df`` is doubled.
    """
    table = mapping.groupBy(code).agg(F.min(canonical).alias("_canonical"))
    out = lookup_join(df, table, code)
    return out.select(
        *[F.col(c) for c in df.columns],
        F.coalesce("_canonical", code).alias(canonical),
        F.col("_canonical").isNotNull().cast("int").alias("is_mapped"),
    )


def unmapped_codes(df: DataFrame, mapping: DataFrame, code: str) -> DataFrame:
    """Codes absent from the mapping with their row counts.

    Codes are counted before the join, so only one row per code is compared.
    """
    counts = df.groupBy(code).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(mapping.select(code), code, "left_anti")
