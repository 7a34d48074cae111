"""Survival estimators.

Every estimator first counts rows per (stratum, day), with map-side combine, and only then
opens windows over those counts. Times must be whole numbers, so a window never holds more
rows than there are days of follow-up, however many entities there are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.plans.skew import as_list

Z95 = 1.959963984540054


def _strata(df: DataFrame, by: str | Sequence[str] | None) -> tuple[DataFrame, list[str], list[str]]:
    """A frame that always has a stratum, its columns, and the columns to return."""
    by = as_list(by)
    return (df, by, by) if by else (df.withColumn("_all", F.lit(0)), ["_all"], [])


def _check_time(df: DataFrame, time: str) -> None:
    if not isinstance(df.schema[time].dataType, (T.IntegralType,)):
        raise TypeError(f"{time} must be a whole number of days (or months); round it first")


def known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in each of the columns: the only ones the estimators count, at risk or as events."""
    return df.dropna(subset=list(columns))


def left_out(df: DataFrame, time: str = "time", event: str = "event", by: str | Sequence[str] | None = None) -> DataFrame:
    """Per stratum, rows without a time or an event, which the estimators leave out."""
    missing = F.col(time).isNull() | F.col(event).isNull()
    return df.groupBy(*as_list(by)).agg(F.count_if(missing).alias("n_left_out"), F.count(F.lit(1)).alias("n_rows"))


def event_table(df: DataFrame, time: str, event: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Per stratum and time: events, censorings and the number at risk just before; see ``known``."""
    _check_time(df, time)
    df, strata, _ = _strata(known(df, time, event), by)
    counts = df.groupBy(*strata, F.col(time).alias("time")).agg(
        F.count_if(F.col(event) == 1).alias("n_event"), F.count_if(F.col(event) != 1).alias("n_censor")
    )
    onwards = Window.partitionBy(*strata).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("at_risk", F.sum(F.col("n_event") + F.col("n_censor")).over(onwards))


def _so_far(strata: Sequence[str]):
    return Window.partitionBy(*strata).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)


def _before(strata: Sequence[str]):
    return Window.partitionBy(*strata).orderBy("time").rowsBetween(Window.unboundedPreceding, -1)


def km(df: DataFrame, time: str = "time", event: str = "event", by: str | Sequence[str] | None = None) -> DataFrame:
    """Kaplan-Meier survival at every observed time (H1).

    Once everyone at risk fails the survival is 0 from there on.
    """
    _, strata, out = _strata(df, by)
    table = event_table(df, time, event, by)
    left = F.lit(1.0) - F.col("n_event") / F.col("at_risk")
    return table.select(
        *out, "time", "at_risk", "n_event", "n_censor", F.product(left).over(_so_far(strata)).alias("survival")
    )


def km_ci(
    df: DataFrame,
    time: str = "time",
    event: str = "event",
    by: str | Sequence[str] | None = None,
    z: float = Z95,
) -> DataFrame:
    """Kaplan-Meier with Greenwood's standard error and log-log limits (H2).

    The error and limits are null where the survival is 0 or 1 and they are undefined.
    """
    _, strata, out = _strata(df, by)
    curve = event_table(df, time, event, by)
    w = _so_far(strata)
    d, n = F.col("n_event").cast("double"), F.col("at_risk").cast("double")
    curve = curve.select(
        *strata, "time", "at_risk", "n_event",
        F.product(F.lit(1.0) - d / n).over(w).alias("survival"),
        F.sum(F.try_divide(d, n * (n - d))).over(w).alias("_g"),
    )
    s = F.col("survival")
    inside = (s > 0) & (s < 1)
    theta = F.lit(z) * F.sqrt("_g") / F.log(s)
    return curve.select(
        *out, "time", "at_risk", "n_event", "survival",
        F.when(s > 0, s * F.sqrt("_g")).alias("std_error"),
        F.when(inside, F.pow(s, F.exp(-theta))).alias("lower"),
        F.when(inside, F.pow(s, F.exp(theta))).alias("upper"),
    )


def nelson_aalen(
    df: DataFrame, time: str = "time", event: str = "event", by: str | Sequence[str] | None = None
) -> DataFrame:
    """Nelson-Aalen cumulative hazard and its variance (H3)."""
    _, strata, out = _strata(df, by)
    table = event_table(df, time, event, by)
    w = _so_far(strata)
    d, n = F.col("n_event").cast("double"), F.col("at_risk").cast("double")
    return table.select(
        *out, "time", "at_risk", "n_event",
        F.sum(d / n).over(w).alias("cum_hazard"), F.sum(d / (n * n)).over(w).alias("variance"),
    )


def cif(
    df: DataFrame,
    causes: Sequence[int],
    time: str = "time",
    cause: str = "cause",
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Aalen-Johansen cumulative incidence of each cause; cause 0 is censoring (H4).

    One row per stratum, time and listed cause. Every nonzero cause counts towards the
    all-cause survival, listed or not.
    """
    _check_time(df, time)
    framed, strata, out = _strata(known(df, time, cause), by)
    counts = framed.groupBy(*strata, F.col(time).alias("time")).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(F.col(cause) != 0).alias("n_event"),
        *[F.count_if(F.col(cause) == c).alias(f"_d{c}") for c in causes],
    )
    onwards = Window.partitionBy(*strata).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("at_risk").cast("double")
    table = counts.withColumn("at_risk", F.sum("n_all").over(onwards))
    table = table.withColumn(
        "_s", F.coalesce(F.product(F.lit(1.0) - F.col("n_event") / n).over(_before(strata)), F.lit(1.0))
    )
    w = _so_far(strata)
    steps = [
        F.struct(
            F.lit(c).alias("cause"),
            F.col(f"_d{c}").alias("n_cause"),
            F.sum(F.col("_s") * F.col(f"_d{c}") / n).over(w).alias("incidence"),
        )
        for c in causes
    ]
    return table.withColumn("_steps", F.array(*steps)).select(
        *out, "time", "at_risk", F.explode("_steps").alias("_c")
    ).select(*out, "time", "at_risk", "_c.*")


def logrank_table(df: DataFrame, group: str, groups: Sequence[str], time: str = "time", event: str = "event") -> DataFrame:
    """Observed, expected and the covariance sums of the log-rank test, as one row.

    The groups are given, so each time is one row with a column per group and the numbers
    at risk need no join.
    """
    _check_time(df, time)
    chosen = known(df, time, event).where(F.col(group).isin(list(groups)))
    per_time = chosen.groupBy(F.col(time).alias("time")).agg(
        *[F.count_if(F.col(group) == g).alias(f"_n{i}") for i, g in enumerate(groups)],
        *[F.count_if((F.col(group) == g) & (F.col(event) == 1)).alias(f"_d{i}") for i, g in enumerate(groups)],
    ).withColumn("_all", F.lit(0))
    onwards = Window.partitionBy("_all").orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    ids = range(len(groups))
    risk = per_time.select(
        "time", *[f"_d{i}" for i in ids], *[F.sum(f"_n{i}").over(onwards).cast("double").alias(f"_r{i}") for i in ids]
    )
    n = sum((F.col(f"_r{i}") for i in ids), F.lit(0.0))
    d = sum((F.col(f"_d{i}") for i in ids), F.lit(0)).cast("double")
    hyper = F.coalesce(F.try_divide(d * (n - d), n - 1), F.lit(0.0))
    sums = []
    for i in ids:
        share = F.col(f"_r{i}") / n
        sums += [F.sum(f"_d{i}").alias(f"o{i}"), F.sum(d * share).alias(f"e{i}")]
        for j in range(i, len(groups)):
            other = F.col(f"_r{j}") / n
            cov = hyper * (share * (F.lit(1.0 if i == j else 0.0) - other))
            sums.append(F.sum(cov).alias(f"v{i}_{j}"))
    return risk.agg(*sums)


def logrank(df: DataFrame, group: str, groups: Sequence[str], time: str = "time", event: str = "event") -> DataFrame:
    """Log-rank test between strata: observed and expected events per group, chi-square, df (H5).

    With two groups the statistic is an expression. With more, the driver solves one
    (groups - 1)-sized linear system from the single aggregated row.
    """
    table = logrank_table(df, group, groups, time, event)
    k = len(groups)
    if k == 2:
        gap = F.col("o0") - F.col("e0")
        chi = F.try_divide(gap * gap, F.col("v0_0"))
    else:
        row = table.first()
        z = np.array([row[f"o{i}"] - row[f"e{i}"] for i in range(k - 1)])
        v = np.array([[row[f"v{min(i, j)}_{max(i, j)}"] for j in range(k - 1)] for i in range(k - 1)])
        chi = F.lit(float(z @ np.linalg.pinv(v) @ z))
    per_group = F.array(
        *[
            F.struct(F.lit(g).alias(group), F.col(f"o{i}").alias("observed"), F.col(f"e{i}").alias("expected"))
            for i, g in enumerate(groups)
        ]
    )
    return table.select(chi.alias("chi2"), F.lit(k - 1).alias("df"), F.explode(per_group).alias("_g")).select(
        "_g.*", "chi2", "df"
    )


def surv_at(curve: DataFrame, horizons: Sequence[int], by: str | Sequence[str] | None = None) -> DataFrame:
    """Survival at fixed horizons, the last step at or before each (H6); 1 before the first step."""
    by = as_list(by)
    long = curve.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    last = F.max_by("survival", F.when(F.col("time") <= F.col("horizon"), F.col("time")))
    return long.groupBy(*by, "horizon").agg(F.coalesce(last, F.lit(1.0)).alias("survival"))


def median_survival(curve: DataFrame, by: str | Sequence[str] | None = None, q: float = 0.5) -> DataFrame:
    """First time the survival is at or below ``q`` (H6); null if never reached."""
    return curve.groupBy(*as_list(by)).agg(F.min(F.when(F.col("survival") <= q, F.col("time"))).alias("median_time"))


def ipcw(df: DataFrame, time: str = "time", event: str = "event", by: str | Sequence[str] | None = None) -> DataFrame:
    """Reverse Kaplan-Meier of censoring: G just before and at each time (H7).

    Events precede censorings at equal times, so those with an event at t are no longer at
    risk of being censored at t.
    """
    _, strata, out = _strata(df, by)
    table = event_table(df, time, event, by)
    stay = F.coalesce(
        F.lit(1.0) - F.try_divide(F.col("n_censor").cast("double"), F.col("at_risk") - F.col("n_event")), F.lit(1.0)
    )
    return table.select(
        *out, "time",
        F.coalesce(F.product(stay).over(_before(strata)), F.lit(1.0)).alias("g_before"),
        F.product(stay).over(_so_far(strata)).alias("g_at"),
    )


def censoring_weight(event: Column, time: Column, horizon: int, g_before: Column, g_horizon: Column) -> Column:
    """Inverse-probability weight at a horizon: 1/G(t-) for events by then, 1/G(h) for survivors, else 0."""
    return (
        F.when((event == 1) & (time <= horizon), F.try_divide(F.lit(1.0), g_before))
        .when(time > horizon, F.try_divide(F.lit(1.0), g_horizon))
        .otherwise(F.lit(0.0))
    )
