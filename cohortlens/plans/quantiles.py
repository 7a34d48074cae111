"""Exact quantiles of groups of any size.

Spark's exact ``percentile`` keeps every distinct value of a group in one task's memory.
Here each round counts a group's values in equal-width bins, with map-side combine, and
keeps only the value range of the bin that holds the wanted rank. A round reads the data
again but moves only the bin counts, and shrinks a group about ``BINS`` times, until its
remaining distinct values fit in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.plans.sizes import few_rows, pin
from cohortlens.plans.skew import GROUP_ROWS, PROBE_BYTES, attach

BINS = 4096
MAX_ROUNDS = 10


def exact_quantile(
    df: DataFrame, x: str, q: float, by: Sequence[str] = (), group_rows: int | None = None, bins: int = BINS
) -> DataFrame:
    """The ``q`` quantile of ``x`` per group, linearly interpolated, in column ``quantile``."""
    rows = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"))
    group = list(by) or ["_all"]
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    if group_rows is None and few_rows(df, GROUP_ROWS, PROBE_BYTES):
        counted = rows.groupBy(*group, "_x").agg(F.count(F.lit(1)).alias("_n"))
        counted = counted.withColumns(
            {"_total": F.sum("_n").over(Window.partitionBy(*group)), "_skipped": F.lit(0).cast("bigint")}
        )
    else:
        ranges, small = _narrow(rows, group, q, group_rows or GROUP_ROWS, bins)
        inside = attach(rows, ranges, group, small, "inner").where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        counted = inside.groupBy(*group, "_x", "_total", "_skipped").agg(F.count(F.lit(1)).alias("_n"))
    return _interpolate(counted, group, q).select(*by, "quantile")


def _rank(q: float):
    """Position of the quantile among ``_total`` ordered values, counted from 0."""
    return (F.col("_total") - 1) * F.lit(float(q))


def _interpolate(counted: DataFrame, group: list[str], q: float) -> DataFrame:
    """Between the two values around the wanted rank; ``_skipped`` values lie below those given."""
    upto = Window.partitionBy(*group).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({"_end": F.sum("_n").over(upto) + F.col("_skipped"), "_pos": _rank(q)})
    picked = ranked.groupBy(*group).agg(
        F.min(F.when(F.col("_end") > F.floor("_pos"), F.col("_x"))).alias("_a"),
        F.min(F.when(F.col("_end") > F.ceil("_pos"), F.col("_x"))).alias("_b"),
        F.max(F.col("_pos") - F.floor("_pos")).alias("_f"),
    )
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")
    return picked.select(*group, value.alias("quantile"))


def _narrow(rows: DataFrame, group: list[str], q: float, group_rows: int, bins: int) -> tuple[DataFrame, bool]:
    """Per group, a value range that holds the wanted ranks, and how many values lie below it.

    Rounds stop when every range holds few rows or a single value. Stopping early would
    cost time, never exactness: the caller ranks whatever the ranges hold.
    """
    ranges, small = pin(
        rows.groupBy(*group).agg(
            F.count(F.lit(1)).alias("_total"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
            F.lit(0).cast("bigint").alias("_skipped"), F.count(F.lit(1)).alias("_inside"),
        )
    )
    for _ in range(MAX_ROUNDS):
        wide = (F.col("_inside") > group_rows) & (F.col("_lo") < F.col("_hi"))
        if ranges.where(wide).isEmpty():
            break
        inside = attach(rows, ranges.where(wide), group, small, "inner")
        inside = inside.where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        share = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        binned = inside.groupBy(
            *group, "_total", "_skipped", F.least(F.lit(bins - 1), F.floor(share * bins).cast("int")).alias("_bin")
        ).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        upto = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        ended = binned.withColumn("_end", F.sum("_n").over(upto) + F.col("_skipped"))
        begin = F.col("_end") - F.col("_n")
        # The bins holding the ranks just below and just above the quantile's position.
        wanted = ended.where((begin <= F.ceil(_rank(q))) & (F.col("_end") > F.floor(_rank(q))))
        narrowed = wanted.groupBy(*group).agg(
            F.max("_total").alias("_total"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
            F.min(begin).alias("_skipped"), F.sum("_n").alias("_inside"),
        )
        ranges, small = pin(narrowed.unionByName(ranges.where(~wide)))
    return ranges, small
