"""Endpoints and time-to-event labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.time import days_between
from cohortlens.plans.scan import ordered_scan


def stage(
    visits: DataFrame,
    *,
    x: str,
    change: str,
    corroborating: str,
    baseline_corroborating: str,
    rules: Sequence[Mapping[str, float]],
    out: str = "stage",
) -> DataFrame:
    """Deterioration stage per visit by rules on level, rise and a second measure (F1).

    A rule is met when the measure rose by ``rise`` to at least ``level`` and the second
    measure fell by ``drop`` or by the share ``drop_share``. A missing second measure does
    not corroborate, so it never raises the stage; a missing first measure gives null.
    """
    fall = F.col(baseline_corroborating) - F.col(corroborating)
    share = F.try_divide(fall, F.col(baseline_corroborating))
    value = F.lit(0)
    for rule in sorted(rules, key=lambda r: r["stage"]):
        rose = (F.col(change) >= rule["rise"]) & (F.col(x) >= rule["level"])
        fell = (fall >= rule["drop"]) | (share >= rule["drop_share"])
        value = F.when(rose & F.coalesce(fell, F.lit(False)), F.lit(int(rule["stage"]))).otherwise(value)
    known = F.col(x).isNotNull() & F.col(change).isNotNull()
    return visits.withColumn(out, F.when(known, value))


def first_event(
    df: DataFrame,
    id: str,
    order: Sequence[str],
    flag: str,
    confirm: int = 0,
    out: str = "event_t",
    group_rows: int | None = None,
) -> DataFrame:
    """First flagged visit per entity, optionally confirmed by the next ``confirm`` visits (F2).

    Consecutive flagged visits share the count of unflagged visits before them, so a run is
    an aggregate over (entity, that count) and the first run longer than ``confirm`` wins.
    Entities without such a run are absent.
    """
    t = order[0]
    on = F.coalesce(F.col(flag).cast("int"), F.lit(0)) == 1
    if confirm == 0:
        return df.where(on).groupBy(id).agg(F.min(t).alias(out))
    marked = df.withColumn("_off", F.when(on, F.lit(0)).otherwise(F.lit(1)))
    scanned = ordered_scan(marked, id, order, running={"_run": "_off"}, group_rows=group_rows)
    runs = scanned.where(F.col("_off") == 0).groupBy(id, "_run").agg(
        F.count(F.lit(1)).alias("_len"), F.min(t).alias("_start")
    )
    return runs.where(F.col("_len") > confirm).groupBy(id).agg(F.min("_start").alias(out))


def resolve_truth(
    sources: Mapping[str, DataFrame], priority: Sequence[str], id: str, t: str, kind: str
) -> DataFrame:
    """One confirmed event per entity from several sources: best source, then earliest."""
    stacked = None
    for rank, name in enumerate(priority):
        one = sources[name].select(
            id, F.col(t), F.col(kind), F.lit(name).alias("source"), F.lit(rank).alias("_rank")
        )
        stacked = one if stacked is None else stacked.unionByName(one)
    best = F.min_by(F.struct(t, kind, "source"), F.struct("_rank", t, kind))
    return stacked.groupBy(id).agg(best.alias("_b")).select(id, "_b.*")


def censored(index: Column, event_t: Column, last_t: Column) -> tuple[Column, Column]:
    """``time`` in days from index to the event or, failing that, the last contact, and ``event``."""
    end = F.coalesce(last_t, event_t, index)
    occurred = event_t.isNotNull() & (event_t.cast("date") <= end.cast("date"))
    time = F.greatest(days_between(F.when(occurred, event_t).otherwise(end), index), F.lit(0))
    return time.alias("time"), occurred.cast("int").alias("event")


def survival_table(
    cohort: DataFrame,
    events: DataFrame,
    last_seen: DataFrame,
    *,
    id: str,
    index: str,
    event_t: str,
    last_t: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Right-censored (time, event) per entity, time in whole days from index.

    An event counts when it is dated on or before the last contact; an event on that very
    day is an event, not a censoring. Entities never seen after index get time 0.
    """
    first = events.groupBy(id).agg(F.min(event_t).alias("_e"))
    last = last_seen.groupBy(id).agg(F.max(last_t).alias("_l"))
    both = cohort.join(first, id, "left").join(last, id, "left")
    return both.select(id, *keep, *censored(F.col(index), F.col("_e"), F.col("_l")))


def competing(
    cohort: DataFrame,
    cause_events: DataFrame,
    last_seen: DataFrame,
    *,
    id: str,
    index: str,
    t: str,
    cause: str,
    last_t: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """First cause and its time; cause 0 is censoring at the last contact.

    Causes are positive integers; on the same day the lowest number wins.
    """
    first = cause_events.groupBy(id).agg(
        F.min(F.struct(F.col(t).cast("date").alias("d"), F.col(cause).cast("int").alias("c"))).alias("_f")
    )
    last = last_seen.groupBy(id).agg(F.max(last_t).cast("date").alias("_l"))
    both = cohort.join(first, id, "left").join(last, id, "left")
    end = F.coalesce(F.col("_l"), F.col("_f.d"), F.col(index).cast("date"))
    occurred = F.col("_f.d").isNotNull() & (F.col("_f.d") <= end)
    time = F.greatest(days_between(F.when(occurred, F.col("_f.d")).otherwise(end), index), F.lit(0))
    return both.select(
        id, *keep, time.alias("time"), F.when(occurred, F.col("_f.c")).otherwise(F.lit(0)).alias("cause")
    )


def horizon_value(time: Column, event: Column, horizon: Column | int) -> Column:
    """1 if the event came by the horizon, 0 if followed up to it or past it, null if censored before it.

    Time-dependent AUROC differs on purpose: its controls are those followed past the horizon,
    because the weight of a control is the censoring survival at the horizon itself.
    """
    h = F.lit(horizon) if isinstance(horizon, int) else horizon
    return F.when((event == 1) & (time <= h), F.lit(1)).when(time >= h, F.lit(0))


def horizon_label(
    df: DataFrame, horizons: Sequence[int], time: str = "time", event: str = "event", keep: Sequence[str] | None = None
) -> DataFrame:
    """Binary label at each horizon, one row per entity and horizon."""
    cols = df.columns if keep is None else list(keep)
    long = df.select(*cols, time, event) if keep is not None else df
    long = long.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    return long.select(*cols, "horizon", horizon_value(F.col(time), F.col(event), F.col("horizon")).alias("label"))


def endpoints(
    cohort: DataFrame, events: DataFrame, kinds: Sequence[str], *, id: str, index: str, t: str, kind: str
) -> DataFrame:
    """Days from index to the first event of each kind, side by side, in one aggregate."""
    firsts = events.where(F.col(kind).isin(list(kinds))).groupBy(id).agg(
        *[F.min(F.when(F.col(kind) == k, F.col(t))).alias(f"_{i}") for i, k in enumerate(kinds)]
    )
    names = ["".join(ch if ch.isalnum() else "_" for ch in k) for k in kinds]
    out = cohort.select(id, index).join(firsts, id, "left")
    return out.select(id, *[days_between(f"_{i}", index).alias(f"days_to_{n}") for i, n in enumerate(names)])


def label_counts(a: DataFrame, b: DataFrame, id: str, label_a: str, label_b: str) -> DataFrame:
    """Confusion counts between two label sets of the same entities, each entity once.

    Of several labels of an entity in one set the greatest counts.
    """
    once = lambda df, label, out: df.groupBy(id).agg(F.max(label).alias(out))
    pairs = once(a, label_a, "a").join(once(b, label_b, "b"), id)
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def label_agreement(counts: DataFrame) -> DataFrame:
    """Observed and expected agreement and Cohen's kappa from ``label_counts`` (F8).

    Works on one row per pair of labels, so its size is that of the label vocabulary.
    """
    both = counts.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    sides = F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb")),
        F.struct(F.col("b").alias("label"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb")),
    )
    agree = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.lit(0))
    # The first side also carries the pair's own counts, so one grouping yields both sums.
    long = both.select(F.posexplode(sides).alias("_i", "_s"), agree.alias("_agree"), F.col("n").alias("_n"))
    long = long.select(
        "_s.*",
        F.when(F.col("_i") == 0, F.col("_agree")).otherwise(F.lit(0)).alias("agree"),
        F.when(F.col("_i") == 0, F.col("_n")).otherwise(F.lit(0)).alias("n"),
    )
    per = long.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("na", "nb", "agree", "n")])
    total = per.agg(
        F.sum("n").alias("n"),
        F.sum("agree").alias("n_agree"),
        F.sum(F.col("na").cast("double") * F.col("nb")).alias("_prod"),
    )
    po = F.try_divide(F.col("n_agree").cast("double"), F.col("n"))
    pe = F.try_divide(F.col("_prod"), F.col("n").cast("double") * F.col("n"))
    return total.select("n", "n_agree", po.alias("observed"), pe.alias("expected")).withColumn(
        "kappa", F.try_divide(F.col("observed") - F.col("expected"), F.lit(1.0) - F.col("expected"))
    )


def person_period(
    df: DataFrame, time: str, event: str, width: int, until: int | None = None
) -> DataFrame:
    """One row per entity and interval at risk, event flagged in its last interval.

    Rows multiply by intervals at risk, so choose months or quarters over days. With
    ``until`` the rows are cut administratively at that time. Negative times count as 0. An
    entity without a time keeps one row, whose period, exposure and event are null.
    """
    at_end, had = F.greatest(F.col(time), F.lit(0)), F.col(event)
    at_end = F.when(F.col(time).isNotNull(), at_end)
    if until is not None:
        had = F.when(at_end <= until, had).otherwise(F.lit(0))
        at_end = F.when(at_end.isNotNull(), F.least(at_end, F.lit(until)))
    last = F.floor(at_end / F.lit(float(width))).cast("int")
    # Follow-up ending exactly on a boundary belongs to the interval it closes.
    last = F.when((at_end > 0) & (F.pmod(at_end, F.lit(width)) == 0), last - 1).otherwise(last)
    out = df.withColumns({"_end": at_end, "_had": had, "_last": last})
    out = out.withColumn("period", F.explode_outer(F.sequence(F.lit(0), F.col("_last"))))
    return out.select(
        *[F.col(c) for c in df.columns],
        "period",
        (F.col("period") * F.lit(width)).alias("period_start"),
        F.when(F.col("period").isNotNull(), F.least(F.col("_end"), (F.col("period") + 1) * F.lit(width)) - F.col("period") * F.lit(width)).alias("exposure"),
        F.when(F.col("period") == F.col("_last"), F.col("_had")).when(F.col("period").isNotNull(), F.lit(0)).alias("period_event"),
    )
