"""Cohort construction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.keys import is_fixed, order_key
from cohortlens.functions.time import days_between, years
from cohortlens.plans.skew import as_list, skew_join


def index_event(
    df: DataFrame, id: str, t: str, cols: Sequence[str], tiebreak: str | Sequence[str] = (), prefix: str = "index_"
) -> DataFrame:
    """First row per entity: its time and the values of ``cols`` as baselines.

    An aggregate, not a window, so each map task sends at most one row per entity. It hashes where
    the order packs into one key and the values are of fixed width, and sorts otherwise.
    """
    key = order_key(df, [t, *as_list(tiebreak)])
    if key is not None and all(is_fixed(df, c) for c in cols):
        firsts = [F.min_by(c, key).alias(f"{prefix}{c}") for c in cols]
        return df.where(F.col(t).isNotNull()).groupBy(id).agg(F.min(t).alias(f"{prefix}{t}"), *firsts, F.count(F.lit(1)).alias("n_visits"))
    first = F.min_by(F.struct(t, *cols), F.struct(t, *as_list(tiebreak)))
    picked = df.where(F.col(t).isNotNull()).groupBy(id).agg(first.alias("_first"), F.count(F.lit(1)).alias("n_visits"))
    return picked.select(
        id,
        F.col(f"_first.{t}").alias(f"{prefix}{t}"),
        *[F.col(f"_first.{c}").alias(f"{prefix}{c}") for c in cols],
        "n_visits",
    )


def include(
    df: DataFrame,
    predicates: Sequence[Column],
    *,
    id: str | None = None,
    visits: DataFrame | None = None,
    t: str | None = None,
    min_visits: int = 0,
    min_follow_up_days: int = 0,
    group_rows: int | None = None,
) -> DataFrame:
    """Rows meeting every criterion, optionally with enough visits and follow-up."""
    out = df
    for predicate in predicates:
        out = out.where(predicate)
    if visits is None:
        return out
    enough = visits.groupBy(id).agg(
        F.count(F.lit(1)).alias("_n"), days_between(F.max(t), F.min(t)).alias("_span")
    )
    enough = enough.where((F.col("_n") >= min_visits) & (F.col("_span") >= min_follow_up_days))
    return skew_join(out, enough.select(id), id, "left_semi", group_rows)


def exclude_history(
    cohort: DataFrame,
    events: DataFrame,
    *,
    id: str,
    index: str,
    t: str,
    kind: str,
    kinds: Sequence[str],
    before_days: int,
    after_days: int,
    group_rows: int | None = None,
) -> DataFrame:
    """Drop entities with one of ``kinds`` within [index - before, index + after] days.

    The offending entities are reduced to one row each before the anti join.
    """
    relevant = events.where(F.col(kind).isin(list(kinds))).select(id, t)
    near = skew_join(relevant, cohort.select(id, index), id, "inner", group_rows)
    gap = days_between(t, index)
    barred = near.where(gap.between(-before_days, after_days)).select(id).distinct()
    return cohort.join(barred, id, "left_anti")


def attrition(df: DataFrame, criteria: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each criterion in order, from a single pass (C4).

    Each row is filed under the first criterion it fails; the table of at most
    ``len(criteria) + 1`` counts is then summed from the end. A null verdict fails.
    """
    names = ["all rows", *[name for name, _ in criteria]]
    failed = F.lit(len(criteria) + 1)
    for step in range(len(criteria), 0, -1):
        failed = F.when(F.coalesce(criteria[step - 1][1], F.lit(False)), failed).otherwise(F.lit(step))
    per_step = [F.count_if(F.col("_failed") > F.lit(i)).alias(f"_{i}") for i in range(len(names))]
    counts = df.select(failed.alias("_failed")).agg(*per_step)
    steps = F.array(
        *[
            F.struct(F.lit(i).alias("step"), F.lit(name).alias("criterion"), F.col(f"_{i}").alias("n_left"),
                     ((F.col(f"_{i - 1}") if i else F.col("_0")) - F.col(f"_{i}")).alias("n_dropped"))
            for i, name in enumerate(names)
        ]
    )
    return counts.select(F.inline(steps))


def cohort_size(df: DataFrame, event: str, n_features: int, by: str | Sequence[str] | None = None) -> DataFrame:
    """Size, events, prevalence and events per variable."""
    events = F.sum(F.col(event).cast("bigint"))
    n = F.count(F.lit(1))
    return df.groupBy(*as_list(by)).agg(
        n.alias("n"),
        events.alias("n_events"),
        F.try_divide(events.cast("double"), n).alias("prevalence"),
        F.try_divide(events.cast("double"), F.lit(n_features)).alias("events_per_variable"),
    )


def incidence(
    df: DataFrame, time: str, event: str, by: str | Sequence[str] | None = None, unit: str = "days"
) -> DataFrame:
    """Crude events per person-year."""
    span = years(F.sum(F.col(time))) if unit == "days" else F.sum(F.col(time)).cast("double")
    events = F.sum(F.col(event).cast("bigint"))
    return df.groupBy(*as_list(by)).agg(
        events.alias("n_events"), span.alias("person_years"), F.try_divide(events.cast("double"), span).alias("rate")
    )
