"""Turning predictions into outputs someone can act on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.plans.skew import as_list, lookup_join

# The largest limit for which Spark filters on a rank before the shuffle, by default.
PRUNED = 1000


def weibull_cdf(scale: Column, shape: Column, t: Column) -> Column:
    """Probability of the event by ``t``."""
    return F.lit(1.0) - F.exp(-F.pow(t / scale, shape))


def risk_table(
    pred: DataFrame, horizons: Sequence[float], id: str, scale: str, shape: str | float, out: str = "risk"
) -> DataFrame:
    """Risk at several horizons as one nested row per entity.

    ``scale`` and ``shape`` are those of a Weibull time, as ``models.fit_aft`` gives them.
    """
    k = F.lit(float(shape)) if isinstance(shape, (int, float)) else F.col(shape)
    risk = F.transform(
        F.array(*[F.lit(h) for h in horizons]),
        lambda h: F.struct(h.alias("horizon"), weibull_cdf(F.col(scale), k, h.cast("double")).alias("prob")),
    )
    return pred.withColumn(out, risk)


def risk_tier(df: DataFrame, p: str, cuts: tuple[float, float], out: str = "tier") -> DataFrame:
    """Low below the first cut, High from the second, Moderate between."""
    low, high = cuts
    return df.withColumn(
        out,
        F.when(F.col(p) < low, "Low").when(F.col(p) < high, "Moderate").when(F.col(p).isNotNull(), "High"),
    )


def next_visit(df: DataFrame, tier: str, plan: DataFrame | Mapping[str, int], last_t: str, out: str = "next_due") -> DataFrame:
    """Date of the next visit: last visit plus the tier's interval in days.

    ``plan`` is a mapping, or a table with columns (tier, days).
    """
    if isinstance(plan, Mapping):
        days = F.lit(None).cast("int")
        for name, value in plan.items():
            days = F.when(F.col(tier) == F.lit(name), F.lit(int(value))).otherwise(days)
        planned = df.withColumn("next_days", days)
    else:
        planned = lookup_join(df, plan.select(F.col("tier").alias(tier), F.col("days").alias("next_days")), tier)
    return planned.withColumn(out, F.date_add(F.col(last_t).cast("date"), F.col("next_days")))


def flag_list(
    df: DataFrame, rule: Column, rank_by: Sequence[Column], k: int, by: str | Sequence[str] | None = None, parts: int = 64
) -> DataFrame:
    """The ``k`` highest-ranked flagged rows, overall or per site.

    Up to ``PRUNED`` rows a site, Spark applies the filter on ``row_number`` inside each map
    task, so a dominant site sends ``k`` rows per task, not all of its own. For a larger ``k``
    it does not; rows are then ranked within ``parts`` parts of each site first, and only the
    ``k`` first of each part meet in the site's own window.
    """
    flagged = df.where(rule)
    by = as_list(by)
    if not by:
        return flagged.orderBy(*rank_by).limit(k)
    if k > PRUNED:
        part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in flagged.columns]), F.lit(parts))
        within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*rank_by))
        flagged = flagged.withColumn("_part", part).withColumn("_rank", within).where(F.col("_rank") <= k).drop("_part", "_rank")
    w = Window.partitionBy(*by).orderBy(*rank_by)
    return flagged.withColumn("list_rank", F.row_number().over(w)).where(F.col("list_rank") <= k)


def reliability(
    df: DataFrame, n_visits: str, device: str, min_visits: int, min_device_n: int, out: str = "reliability"
) -> DataFrame:
    """ok, or why a prediction is weak: sparse follow-up, a device with little history, or both."""
    history = df.groupBy(device).agg(F.count(F.lit(1)).alias("n_device"))
    both = lookup_join(df, history, device)
    sparse = F.coalesce(F.col(n_visits), F.lit(0)) < min_visits
    rare = F.coalesce(F.col("n_device"), F.lit(0)) < min_device_n
    return both.withColumn(
        out,
        F.when(sparse & rare, "sparse follow-up, new device")
        .when(sparse, "sparse follow-up")
        .when(rare, "new device")
        .otherwise("ok"),
    )
