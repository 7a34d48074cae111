"""The prediction record: everything said about an entity, in one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.models import top_contributions
from cohortlens.operators.scoring import risk_table, risk_tier


def prediction_record(
    pred: DataFrame, id: str, scale: str, shape: str | float, horizons: Sequence[int], cuts: tuple[float, float],
    plan: Mapping[str, int], coef: Mapping[str, float], means: Mapping[str, float], k: int = 3,
) -> DataFrame:
    """(id, risk, tier, top, next_days): all that is said about an entity, in one row.

    ``risk`` holds a probability per horizon, the tier follows from the first of them, ``top``
    are the k largest contributions to the linear predictor and ``next_days`` the tier's interval.
    Made from the row alone: nothing is shuffled.
    """
    d = risk_table(pred, list(horizons), id, scale, shape)
    d = risk_tier(d.withColumn("_p", F.col("risk")[0]["prob"]), "_p", cuts)
    d = top_contributions(d, coef, means, k)
    days = F.lit(None).cast("int")
    for name, value in plan.items():
        days = F.when(F.col("tier") == F.lit(name), F.lit(int(value))).otherwise(days)
    return d.select(id, "risk", "tier", "top", days.alias("next_days"))
