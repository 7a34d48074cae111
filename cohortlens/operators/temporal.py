"""Aligning irregular visits in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.time import day_number, days_between
from cohortlens.plans.scan import ordered_scan
from cohortlens.plans.skew import as_list, attach, hot_keys, skew_join


def value_at(
    visits: DataFrame,
    cohort: DataFrame,
    *,
    id: str,
    t: str,
    index: str,
    x: str,
    horizons: Sequence[int],
    back: int,
    ahead: int = 0,
    how: str = "nearest",
    tiebreak: str | Sequence[str] = (),
    group_rows: int | None = None,
) -> DataFrame:
    """The measure at each horizon (days after index), one row per entity and horizon.

    nearest  smallest gap inside [horizon - back, horizon + ahead]; ties go to the earlier visit
    last     latest visit inside [horizon - back, horizon]

    Visits are filtered to the union of all windows before any row is repeated, and the
    choice is an aggregate, so only one row per entity and horizon leaves each map task.
    """
    if how not in ("nearest", "last"):
        raise ValueError("how must be nearest or last")
    ahead = 0 if how == "last" else ahead
    hs = sorted(horizons)
    ties = as_list(tiebreak)
    dated = skew_join(
        visits.where(F.col(x).isNotNull()).select(id, t, x, *ties), cohort.select(id, index), id, "inner", group_rows
    ).withColumn("_day", days_between(t, index))
    dated = dated.where(F.col("_day").between(hs[0] - back, hs[-1] + ahead))
    offered = F.filter(
        F.array(*[F.lit(h) for h in hs]), lambda h: F.col("_day").between(h - F.lit(back), h + F.lit(ahead))
    )
    near = dated.withColumn("horizon", F.explode(offered))
    gap = F.abs(F.col("_day") - F.col("horizon"))
    # Rows are compared so that the smallest wins; for "last" a later visit has the smaller gap,
    # and among visits of one day the last in tie order must win.
    if how == "nearest":
        best = F.min_by(F.struct("_day", x), F.struct(gap, t, *ties))
    else:
        best = F.max_by(F.struct("_day", x), F.struct(t, *ties))
    chosen = near.groupBy(id, "horizon").agg(best.alias("_b"))
    grid = cohort.select(id, F.explode(F.array(*[F.lit(h) for h in hs])).alias("horizon"))
    return grid.join(chosen, [id, "horizon"], "left").select(
        id, "horizon", F.col("_b._day").alias("day"), F.col(f"_b.{x}").alias(x)
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    *,
    by: str | Sequence[str],
    t: str,
    left_order: Sequence[str] = (),
    right_order: Sequence[str] = (),
    tolerance_days: int | None = None,
    suffix: str = "_asof",
    group_rows: int | None = None,
) -> DataFrame:
    """Latest right row at or before each left time within ``by``.

    Both sides are stacked and the last right row is carried forward, so each input is
    shuffled once and no pairs are formed. Right columns come back with ``suffix``.
    """
    by = as_list(by)
    values = [c for c in right.columns if c not in by]
    ties = max(len(left_order), len(right_order))
    pad = lambda cols: [*cols, *[None] * (ties - len(cols))]

    def stacked(df: DataFrame, side: int, order: Sequence[str | None]):
        keep = [F.col(c) for c in by] + [F.col(t).alias("_t"), F.lit(side).alias("_side")]
        keep += [(F.col(c) if c else F.lit(None)).cast("string" if not c else df.schema[c].dataType).alias(f"_o{i}")
                 for i, c in enumerate(order)]
        mine = F.struct(*[F.col(c) for c in (left if side else right).columns])
        other = (right if side else left).select(F.struct("*").alias("s")).schema["s"].dataType
        lcol = mine if side else F.lit(None).cast(other)
        rcol = F.lit(None).cast(other) if side else mine
        return df.select(*keep, lcol.alias("_left"), rcol.alias("_right"))

    both = stacked(right, 0, pad(right_order)).unionByName(stacked(left, 1, pad(left_order)))
    order = ["_t", "_side", *[f"_o{i}" for i in range(ties)]]
    scanned = ordered_scan(both, by, order, carry={"_match": "_right"}, group_rows=group_rows)
    match = F.col("_match")
    if tolerance_days is not None:
        match = F.when(days_between(F.col("_t"), F.col(f"_match.{t}")) <= tolerance_days, match)
    hits = scanned.where(F.col("_side") == 1).withColumn("_match", match)
    return hits.select("_left.*", *[F.col(f"_match.{c}").alias(f"{c}{suffix}") for c in values])


def visit_grid(cohort: DataFrame, id: str, index: str, every_days: int, until_days: int) -> DataFrame:
    """Expected visits on a fixed schedule: one row per entity and slot (D3)."""
    slots = F.sequence(F.lit(1), F.lit(until_days // every_days))
    if until_days < every_days:
        return cohort.select(id, index).limit(0).select(
            id, F.lit(0).alias("slot"), F.col(index).cast("date").alias("due")
        )
    return cohort.select(id, F.col(index).cast("date").alias("_d"), F.explode(slots).alias("slot")).select(
        id, "slot", F.date_add("_d", F.col("slot") * F.lit(every_days)).alias("due")
    )


def missed_visits(
    grid: DataFrame,
    visits: DataFrame,
    cohort: DataFrame,
    *,
    id: str,
    t: str,
    index: str,
    every_days: int,
    tol_days: int,
    group_rows: int | None = None,
) -> DataFrame:
    """Grid slots with no visit within tolerance of the due date.

    Each visit is turned into the slot numbers it satisfies, so the anti join is on
    (entity, slot) with no date range left in it.
    """
    dated = skew_join(visits.select(id, t), cohort.select(id, index), id, "inner", group_rows)
    day = days_between(t, index)
    first = F.ceil((day - F.lit(tol_days)) / F.lit(float(every_days))).cast("int")
    last = F.floor((day + F.lit(tol_days)) / F.lit(float(every_days))).cast("int")
    met = dated.select(id, first.alias("_a"), last.alias("_b")).where("_a <= _b")
    met = met.select(id, F.explode(F.sequence("_a", "_b")).alias("slot")).distinct()
    return grid.join(met, [id, "slot"], "left_anti")


def events_by_missingness(
    missed: DataFrame, survival: DataFrame, *, id: str, every_days: int, until_days: int, time: str = "time", event: str = "event"
) -> DataFrame:
    """(status, n, n_event, days, rate) by how many of the visits due in follow-up were missed (D4 against F4).

    Only visits due up to the end of an entity's follow-up count, so that dying or leaving early
    is not itself missingness: ``none due``, ``none``, ``some`` (up to half) or ``most`` missed. The
    rate is events per 100 years at risk. Tells whether absence is informative.
    """
    late = skew_join(missed.select(id, "slot"), survival.select(id, time), id).where(F.col("slot") * every_days <= F.col(time))
    counted = survival.where(F.col(time).isNotNull() & F.col(event).isNotNull()).join(late.groupBy(id).agg(F.count(F.lit(1)).alias("_missed")), id, "left")
    due = F.least(F.floor(F.col(time) / F.lit(float(every_days))), F.lit(until_days // every_days))
    gone = F.coalesce("_missed", F.lit(0))
    status = F.when(due <= 0, "none due").when(gone == 0, "none").when(2 * gone <= due, "some").otherwise("most")
    out = counted.groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(event) == 1).alias("n_event"), F.sum(F.col(time).cast("bigint")).alias("days")
    )
    return out.withColumn("rate", F.try_divide(F.col("n_event") * F.lit(36525.0), F.col("days").cast("double")))


def locf(
    df: DataFrame,
    id: str,
    order: Sequence[str],
    x: str,
    max_age_days: int | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Carry the last observed value forward into ``<x>_locf``.

    ``order`` starts with the time column and must be total within an entity. With
    ``max_age_days`` a value older than that is not carried.
    """
    t = order[0]
    seen = df.withColumn("_seen", F.when(F.col(x).isNotNull(), F.struct(F.col(t).alias("t"), F.col(x).alias("x"))))
    out = ordered_scan(seen, id, order, carry={"_last": "_seen"}, group_rows=group_rows)
    value = F.col("_last.x")
    if max_age_days is not None:
        value = F.when(days_between(F.col(t), F.col("_last.t")) <= max_age_days, value)
    return out.select(*[F.col(c) for c in df.columns], value.alias(f"{x}_locf"))


def visit_gaps(
    df: DataFrame, id: str, order: Sequence[str], last_days: int = 365, group_rows: int | None = None
) -> DataFrame:
    """Days since the previous visit, largest gap so far, visits in the last N days.

    The count covers visits dated in [day - last_days, day], the row's own day included.
    A hot entity's visits are first counted per day, which bounds its window by the length
    of follow-up rather than by its visits.
    """
    t = order[0]
    hot = hot_keys(df, id, group_rows)
    scanned = ordered_scan(df, id, order, prev={"_pt": t}, hot=hot, probe=False, group_rows=group_rows)
    out = scanned.withColumns({"gap_days": days_between(t, "_pt"), "_day": day_number(t)}).drop("_pt")
    recent = Window.partitionBy(id).orderBy("_day").rangeBetween(-last_days, 0)
    sofar = Window.partitionBy(id).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if hot is None:
        out = out.withColumns(
            {"max_gap_days": F.max("gap_days").over(sofar), "n_recent": F.count(F.lit(1)).over(recent)}
        )
        return out.drop("_day")
    # Gaps within a day are 0 except on its first row, so the day's largest gap is that row's.
    # Every row of a day therefore sees the same largest gap so far.
    per_day = out.groupBy(id, "_day").agg(F.count(F.lit(1)).alias("_n"), F.max("gap_days").alias("_g"))
    upto = Window.partitionBy(id).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    per_day = per_day.select(
        id, "_day", F.max("_g").over(upto).alias("_gmax"), F.sum("_n").over(recent).alias("n_recent")
    )
    out = attach(out, per_day, [id, "_day"], small=False)
    largest = F.when(F.col("gap_days").isNotNull(), F.col("_gmax"))
    return out.select(*[F.col(c) for c in df.columns], "gap_days", largest.alias("max_gap_days"), "n_recent")


def gap_summary(gaps: DataFrame, id: str) -> DataFrame:
    """One row per entity over the output of ``visit_gaps``."""
    return gaps.groupBy(id).agg(
        F.count(F.lit(1)).alias("n_visits"),
        F.max("gap_days").alias("max_gap_days"),
        F.avg("gap_days").alias("mean_gap_days"),
        F.max("n_recent").alias("max_recent"),
    )
