"""Ranks over a whole table, by range partitions.

A window without a partition puts every row in one task. Here the values are
range-partitioned, written once, and numbered within each range; one row per range gives
the numbers where each begins. The ranges are cut by counts of values, so the spread of the
values does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.plans.sizes import pin
from cohortlens.plans.skew import attach
from cohortlens.session import materialized


def dense_ranks(df: DataFrame, column: str, out: str = "_rank") -> DataFrame:
    """(column, out): the distinct values of ``column`` other than null, numbered from 0 in their order."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = materialized(values.repartitionByRange(column).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    begins = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    return ranged.join(F.broadcast(begins), "_range").select(column, (F.col("_begin") + place).alias(out))


def positions(df: DataFrame, within: Sequence[str], order: Sequence[str], out: str, parts: int) -> DataFrame:
    """``df`` with ``out``: each row's place, from 0, among the rows of equal ``within``, in ``order``, nulls first.

    Ranges are cut by the whole of ``within`` and ``order``, of any types, so that each of about
    ``parts`` tasks numbers as many rows, however the values lie. Rows equal in all of it are placed anyhow.
    """
    keys = [*within, *order, "_tie"]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys)
    ranged = materialized(ranged.withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range and group
    begins, small = pin(sizes.select(*within, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin")))
    place = F.row_number().over(Window.partitionBy(*within, "_range").orderBy(*order, "_tie")) - 1
    both = attach(ranged, begins, [*within, "_range"], small, how="inner")
    return both.withColumn(out, F.col("_begin") + place).select(*df.columns, out)
