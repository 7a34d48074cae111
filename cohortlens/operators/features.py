"""Features from baseline and serial measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.time import day_number, days_between, years
from cohortlens.plans.quantiles import exact_quantile
from cohortlens.plans.scan import ordered_scan
from cohortlens.plans.skew import as_list, lookup_join, skew_join


def progression(df: DataFrame, id: str, t: str, x: str) -> DataFrame:
    """Least-squares slope of a measure per year, one row per entity.

    Null when the entity has fewer than two distinct times.
    """
    seen = df.where(F.col(x).isNotNull() & F.col(t).isNotNull())
    day = day_number(t)
    slope = F.regr_slope(F.col(x), years(day))
    return seen.groupBy(id).agg(
        F.count(F.lit(1)).alias("n_measures"),
        F.when(F.min(day) < F.max(day), slope).alias("slope_per_year"),
    )


def visit_rate(df: DataFrame, id: str, order: Sequence[str], x: str, group_rows: int | None = None) -> DataFrame:
    """Change per year since the previous visit (E2); null on first and same-day visits."""
    t = order[0]
    out = ordered_scan(df, id, order, prev={"_pt": t, "_px": x}, group_rows=group_rows)
    rate = F.try_divide(F.col(x) - F.col("_px"), years(days_between(t, "_pt")))
    return out.select(*[F.col(c) for c in df.columns], rate.alias(f"{x}_rate_per_year"))


def indexed(df: DataFrame, x: str, size: str | Column, out: str | None = None) -> DataFrame:
    """A measure divided by body size; null when size is missing or zero."""
    size = F.col(size) if isinstance(size, str) else size
    return df.withColumn(out or f"{x}_indexed", F.try_divide(F.col(x), size))


def mismatch(
    df: DataFrame, x: str, stratum: str, limits: Mapping[str, tuple[float, float]], out: str = "mismatch"
) -> DataFrame:
    """none / moderate / severe by stratum-dependent upper limits (severe, moderate).

    Null when the measure or the stratum is missing or the stratum has no limits.
    """
    grade = F.lit(None).cast("string")
    for name, (severe, moderate) in limits.items():
        here = F.when(F.col(x) <= severe, "severe").when(F.col(x) <= moderate, "moderate").when(
            F.col(x) > moderate, "none"
        )
        grade = F.when(F.col(stratum) == F.lit(name), here).otherwise(grade)
    return df.withColumn(out, grade)


def from_baseline(
    visits: DataFrame, index: DataFrame, *, id: str, x: str, baseline: str, keep: Sequence[str] = (),
    group_rows: int | None = None,
) -> DataFrame:
    """Absolute and relative change of each visit from the entity's baseline (E5).

    ``keep`` names further index columns to carry along.
    """
    out = skew_join(visits, index.select(id, baseline, *keep), id, "inner", group_rows)
    change = F.col(x) - F.col(baseline)
    return out.withColumns(
        {f"{x}_change": change, f"{x}_change_share": F.try_divide(change, F.col(baseline))}
    )


def missing_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """An INT flag ``<name>_missing`` per column."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in cols})


class Imputation:
    """Values learned from one split, applied to any other."""

    def __init__(self, cols: Sequence[str], by: Sequence[str], overall: Mapping[str, float | None],
                 per_group: DataFrame | None):
        self.cols, self.by = list(cols), list(by)
        self.overall, self.per_group = dict(overall), per_group

    def apply(self, df: DataFrame) -> DataFrame:
        """Fill nulls with the group's value, or the overall value where the group has none."""
        out = df if self.per_group is None else lookup_join(df, self.per_group, self.by)
        filled = {}
        for c in self.cols:
            group_value = [F.col(f"_fit_{c}")] if self.per_group is not None else []
            filled[c] = F.coalesce(F.col(c), *group_value, F.lit(self.overall[c]).cast("double"))
        return out.withColumns(filled).select(*df.columns)


def fit_impute(
    train: DataFrame,
    cols: Sequence[str],
    by: str | Sequence[str] | None = None,
    how: str = "median",
    constant: float | None = None,
) -> Imputation:
    """Learn fill values on the training rows only.

    how  constant, mean, or median (exact, by repeated narrowing; see ``plans.quantiles``)
    """
    by, cols = as_list(by), list(cols)
    if how == "constant":
        return Imputation(cols, [], {c: constant for c in cols}, None)
    if how == "mean":
        fit = lambda groups: train.groupBy(*groups).agg(*[F.avg(c).alias(f"_fit_{c}") for c in cols])
    elif how == "median":
        fit = lambda groups: _medians(train, cols, groups)
    else:
        raise ValueError("how must be constant, mean or median")
    row = fit([]).first()
    overall = {c: row[f"_fit_{c}"] if row else None for c in cols}
    return Imputation(cols, by, overall, fit(by) if by else None)


def _medians(train: DataFrame, cols: Sequence[str], groups: Sequence[str]) -> DataFrame:
    out = None
    for c in cols:
        one = exact_quantile(train, c, 0.5, groups).withColumnRenamed("quantile", f"_fit_{c}")
        if out is None:
            out = one
        elif groups:
            out = out.join(one, list(groups), "full")
        else:
            out = out.withColumn(f"_fit_{c}", F.lit(one.first()[0]))
    return out


def pivot_flags(df: DataFrame, id: str, code: str, codes: Sequence[str], prefix: str = "has_") -> DataFrame:
    """One 0/1 column per listed code, one row per entity.

    The code list is given, so no job is spent finding it and the schema is fixed.
    """
    flags = [
        F.max((F.col(code) == F.lit(c)).cast("int")).alias(prefix + "".join(ch if ch.isalnum() else "_" for ch in c))
        for c in codes
    ]
    return df.groupBy(id).agg(*flags).na.fill(0)


def feature_pipeline(numeric: Sequence[str], categorical: Sequence[str], out: str = "features") -> Pipeline:
    """Index and one-hot encode categories, then assemble with the numeric columns.

    Unseen categories and null numbers are kept rather than failing or dropping rows.
    """
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep",
                              stringOrderType="alphabetAsc") for c in categorical]
    stages = list(indexers)
    if categorical:
        stages.append(OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical],
                                    outputCols=[f"{c}_vec" for c in categorical], handleInvalid="keep"))
    inputs = [*numeric, *[f"{c}_vec" for c in categorical]]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep"))
    return Pipeline(stages=stages)
