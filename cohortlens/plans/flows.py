"""The operators joined end to end, on whatever tables the caller has."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.cleaning import dedup
from cohortlens.operators.cohort import index_event
from cohortlens.operators.endpoints import censored, first_event
from cohortlens.operators.evaluation import calibration, cindex, td_auc
from cohortlens.operators.features import fit_impute, from_baseline, missing_flags, progression
from cohortlens.operators.models import WeibullModel, fit_aft
from cohortlens.operators.splits import split_entity
from cohortlens.operators.survival import km
from cohortlens.operators.temporal import value_at
from cohortlens.plans.skew import hot_keys, skew_join
from cohortlens.session import materialized

#: More than the number of any cause: a day and a cause are packed into one whole number, which a hash aggregate holds.
CAUSES = 1 << 16


def time_to_crossing(
    visits: DataFrame, entities: DataFrame, *, id: str, order: Sequence[str], x: str, rise: float, level: float,
    keep: Sequence[str] = (), group_rows: int | None = None,
) -> DataFrame:
    """Records to a survival table: when did the measure first rise by ``rise`` to ``level``?

    De-duplicates visits on ``(id, *order)``, takes the first as the index, and censors at
    the last visit. Ordinarily the visits are read once and shuffled once. If some entity
    is too big for one task, the same steps run as aggregates and split joins instead.
    """
    t = order[0]
    per = _crossing_history(visits, id, order, x, rise, level, group_rows)
    index = [f"index_{t}", f"index_{x}", "n_visits"]
    joined = per.join(entities.select(id, *keep), id)
    return joined.select(id, *keep, *index, *censored(F.col(f"index_{t}"), F.col("_event"), F.col("_last")))


def time_to_causes(
    visits: DataFrame, entities: DataFrame, others: DataFrame, *, id: str, order: Sequence[str], x: str, rise: float, level: float,
    t: str, cause: str = "cause", after_days: int = 0, keep: Sequence[str] = (), group_rows: int | None = None,
) -> DataFrame:
    """Records to a competing-risks table (time, cause): the measure's crossing is cause 1, dated ``others`` are theirs.

    ``others`` count when they are dated more than ``after_days`` after the index; on one day the lowest
    cause wins, and cause 0 is censoring at the last visit. Index, crossing and last visit come from
    one pass over the visits, written as a row per entity, which the others then look up.
    """
    index = f"index_{order[0]}"
    known = materialized(_crossing_history(visits, id, order, x, rise, level, group_rows).join(entities.select(id, *keep), id))
    dated = skew_join(others.select(id, F.col(t).cast("date").alias("_t"), F.col(cause).alias("_c")), known.select(id, index), id, "inner", group_rows)
    packed = lambda day, number: F.unix_date(day).cast("bigint") * CAUSES + number
    first = dated.where(F.datediff("_t", index) > after_days).groupBy(id).agg(F.min(packed(F.col("_t"), F.col("_c"))).alias("_other"))
    first_cause = F.least(packed(F.col("_event").cast("date"), F.lit(1)), F.col("_other"))
    both = known.join(first, id, "left").withColumns({"_f": first_cause, "_end": F.unix_date(F.col("_last").cast("date"))})
    occurred = F.coalesce(F.floor(F.col("_f") / F.lit(float(CAUSES))) <= F.col("_end"), F.lit(False))
    day = F.when(occurred, F.floor(F.col("_f") / F.lit(float(CAUSES)))).otherwise(F.col("_end"))
    time = F.greatest((day - F.unix_date(F.col(index).cast("date"))).cast("int"), F.lit(0))
    return both.select(id, *keep, time.alias("time"), F.when(occurred, F.pmod(F.col("_f"), F.lit(CAUSES)).cast("int")).otherwise(F.lit(0)).alias("cause"))


def _crossing_history(visits, id, order, x, rise, level, group_rows):
    """(id, index time and measure, n_visits, _event, _last) per entity."""
    visits = visits.where(F.col(order[0]).isNotNull() & F.col(id).isNotNull()).select(id, *order, x)
    plan = _crossing_one_shuffle if hot_keys(visits, id, group_rows) is None else _crossing_split
    return plan(visits, id, list(order), x, rise, level, group_rows)


def _crossed(x: str, rise: float, level: float):
    return (F.col(x) - F.col(f"index_{x}") >= rise) & (F.col(x) >= level)


def _crossing_one_shuffle(visits, id, order, x, rise, level, group_rows):
    """All of an entity's visits meet in one task, where every step is a pass over them."""
    t = order[0]
    clean = dedup(visits.repartition(id), [id, *order], [F.desc(x)])
    first = Window.partitionBy(id).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    based = clean.withColumns({f"index_{c}": F.first(c).over(first) for c in (t, x)})
    return based.groupBy(id).agg(
        F.min(f"index_{t}").alias(f"index_{t}"),
        F.min(f"index_{x}").alias(f"index_{x}"),
        F.count(F.lit(1)).alias("n_visits"),
        F.min(F.when(_crossed(x, rise, level), F.col(t))).alias("_event"),
        F.max(t).alias("_last"),
    )


def _crossing_split(visits, id, order, x, rise, level, group_rows):
    """Nothing but per-task partial aggregates and a salted join touches a big entity's visits."""
    t, ties = order[0], order[1:]
    clean = dedup(visits, [id, *order], [F.desc(x)])
    index = index_event(clean, id, t, [x], ties)
    changed = from_baseline(clean, index, id=id, x=x, baseline=f"index_{x}", group_rows=group_rows)
    events = first_event(changed.withColumn("_flag", _crossed(x, rise, level).cast("int")), id, order, "_flag", out="_event")
    last = clean.groupBy(id).agg(F.max(t).alias("_last"))
    return index.join(events, id, "left").join(last, id)


def crossing_curves(visits: DataFrame, entities: DataFrame, by: str, **how) -> DataFrame:
    """Kaplan-Meier curve of time to threshold crossing per subgroup."""
    return km(time_to_crossing(visits, entities, keep=[by], **how), by=by)


def landmark_features(
    visits: DataFrame, survival: DataFrame, *, id: str, order: Sequence[str], x: str, index: str, landmark: int
) -> DataFrame:
    """Features known at a landmark (days after index) for entities still at risk then.

    Only visits up to the landmark are used, and time is counted from it, so nothing dated
    after the prediction leaks into a feature.
    """
    at_risk = survival.where(F.col("time") > landmark)
    t = order[0]
    early = skew_join(visits, at_risk.select(id, index), id)
    early = early.where(F.datediff(t, index) <= landmark).select(*visits.columns)
    slope = progression(early, id, t, x).select(id, "slope_per_year", F.col("n_measures").cast("double").alias("n_measures"))
    now = value_at(early, at_risk, id=id, t=t, index=index, x=x, horizons=[landmark], back=landmark, how="last",
                   tiebreak=list(order[1:])).select(id, F.col(x).alias("latest"))
    out = at_risk.join(slope, id, "left").join(now, id, "left")
    out = out.withColumn("time", F.col("time") - F.lit(landmark))
    return missing_flags(out, ["slope_per_year", "latest"])


def train_and_evaluate(
    features: DataFrame, columns: Sequence[str], *, id: str, horizon: int, weights: Mapping[str, float] | None = None
) -> tuple[WeibullModel, DataFrame, dict[str, DataFrame]]:
    """Split by entity, impute from the training part, fit, score the test part, evaluate.

    The split table is written once, since fitting reads it many times.
    """
    parts = materialized(split_entity(features, id, weights or {"train": 0.7, "test": 0.3}, "flow"))
    train = parts.where(F.col("split") == "train")
    fill = fit_impute(train, columns)
    model = fit_aft(fill.apply(train), columns)
    scored = materialized(model.risk(fill.apply(parts.where(F.col("split") == "test")), horizon))
    metrics = {
        "concordance": cindex(scored),
        "auc": td_auc(scored, horizon),
        "calibration": calibration(scored, "score", horizon),
    }
    return model, scored, metrics
