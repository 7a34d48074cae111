"""Cleaning and data quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.time import days_between
from cohortlens.plans.skew import as_list, skew_join


def dedup(df: DataFrame, keys: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Keep the first row of each key under ``order`` (B1).

    Spark prunes a ``row_number() = 1`` filter to one row per key inside each map task
    before it shuffles, so a key with very many copies costs one row per task.
    """
    w = Window.partitionBy(*as_list(keys)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def range_clean(df: DataFrame, limits: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Null values outside [lo, hi] and flag them in ``<name>_out_of_range`` (B2)."""
    cols: dict[str, Column] = {}
    for name, (lo, hi) in limits.items():
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (F.col(name) < F.lit(lo))
        if hi is not None:
            bad = bad | (F.col(name) > F.lit(hi))
        bad = F.coalesce(bad | F.isnan(F.col(name).cast("double")), F.lit(False))
        cols[f"{name}_out_of_range"] = bad.cast("int")
        cols[name] = F.when(~bad, F.col(name))
    return df.withColumns(cols)


def normalize_units(df: DataFrame, x: str, unit: str, factors: Mapping[str, float], canonical: str) -> DataFrame:
    """Convert ``x`` to the canonical unit by ``factors`` (unit -> multiplier).

    A value in an unknown unit becomes null and is flagged, since its size means nothing.
    """
    factor = F.lit(None).cast("double")
    for name, value in factors.items():
        factor = F.when(F.col(unit) == F.lit(name), F.lit(float(value))).otherwise(factor)
    return df.withColumns(
        {
            x: F.col(x) * factor,
            f"{x}_unit_unknown": (F.col(x).isNotNull() & factor.isNull()).cast("int"),
            unit: F.when(factor.isNotNull(), F.lit(canonical)).otherwise(F.col(unit)),
        }
    )


def extract_measures(df: DataFrame, text: str, patterns: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per number found in free text: ``keep`` columns, measure, position, value.

    Each pattern's first group is the number. All matches in the whole text are returned,
    in order; a match that is not a number is kept with a null value.
    """

    def matches(name: str, pattern: str) -> Column:
        texts = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
        return F.transform(
            texts,
            lambda v, i: F.struct(
                F.lit(name).alias("measure"),
                (i + 1).cast("int").alias("position"),
                F.regexp_replace(v, ",", ".").try_cast("double").alias("value"),
            ),
        )

    found = F.array(*[matches(name, pattern) for name, pattern in patterns.items()])
    return df.select(*keep, F.explode(F.flatten(found)).alias("_m")).select(*keep, "_m.*")


def availability(
    visits: DataFrame,
    cohort: DataFrame,
    *,
    id: str,
    t: str,
    index: str,
    horizon_days: int,
    tol_days: int,
    min_share: float,
    by: str | Sequence[str],
    group_rows: int | None = None,
) -> DataFrame:
    """Share of entities with a visit near a horizon after their index date, per group."""
    by = as_list(by)
    seen = skew_join(visits.select(id, t), cohort.select(id, index), id, "inner", group_rows)
    seen = seen.where(F.abs(days_between(t, index) - horizon_days) <= tol_days).select(id).distinct()
    flagged = cohort.select(id, *by).join(seen.withColumn("_seen", F.lit(1)), id, "left")
    share = F.avg(F.coalesce(F.col("_seen"), F.lit(0)))
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_seen").alias("n_available"),
        share.alias("share"),
        (share >= F.lit(min_share)).cast("int").alias("meets_share"),
    )


def missing_profile(df: DataFrame, cols: Sequence[str], by: str | Sequence[str] | None = None) -> DataFrame:
    """Missing count and rate per column and group, one row each."""
    by = as_list(by)
    wide = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    )
    long = wide.unpivot([*by, "n"], list(cols), "column", "n_missing")
    return long.withColumn("missing_rate", F.try_divide(F.col("n_missing").cast("double"), F.col("n")))


def drop_sparse(
    df: DataFrame, cols: Sequence[str], max_col_rate: float = 1.0, max_row_rate: float = 1.0
) -> DataFrame:
    """Drop columns whose missing rate, then rows whose missing share, exceeds a limit.

    Column rates take one aggregate pass that returns a single row; rows are then judged
    on the columns that remain.
    """
    cols = list(cols)
    if max_col_rate < 1.0:
        rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
        gone = [c for c in cols if rates[c] is not None and rates[c] > max_col_rate]
        df, cols = df.drop(*gone), [c for c in cols if c not in gone]
    if not cols or max_row_rate >= 1.0:
        return df
    missing = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.where(missing / F.lit(float(len(cols))) <= F.lit(max_row_rate))


def reader_variability(df: DataFrame, keys: str | Sequence[str], reader: str, x: str) -> DataFrame:
    """Spread of repeated reads of one measurement by different readers."""
    return (
        df.where(F.col(x).isNotNull())
        .groupBy(*as_list(keys))
        .agg(
            F.count(F.lit(1)).alias("n_reads"),
            F.count_distinct(reader).alias("n_readers"),
            F.avg(x).alias("mean_read"),
            F.stddev_samp(x).alias("sd_read"),
            (F.max(x) - F.min(x)).alias("range_read"),
        )
        .where(F.col("n_readers") > 1)
    )


def pooled_variability(reads: DataFrame) -> DataFrame:
    """Pooled within-measurement SD over the output of ``reader_variability``."""
    df_ = F.col("n_reads") - 1
    ss = F.sum(df_ * F.col("sd_read") * F.col("sd_read"))
    return reads.agg(
        F.count(F.lit(1)).alias("n_measurements"),
        F.sum("n_reads").alias("n_reads"),
        F.sqrt(F.try_divide(ss, F.sum(df_).cast("double"))).alias("pooled_sd"),
    )

