"""Risk models on ``spark.ml``: thin set-up around distributed estimators.

Training reads its input many times. Pass a written feature table, not a
long plan; ``session.materialized`` makes one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.hashing import bucket, hash32
from cohortlens.operators.scoring import weibull_cdf


def _assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    """Missing values are an error here: impute them first, fitted on the training rows."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


@dataclass
class WeibullModel:
    """A fitted Weibull accelerated-failure-time model."""

    pipeline: PipelineModel
    shape: float

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``scale``, the Weibull scale of each row; the shape is shared."""
        return self.pipeline.transform(df).drop("features").withColumnRenamed("prediction", "scale")

    def risk(self, df: DataFrame, horizon: int, out: str = "score") -> DataFrame:
        scored = self.transform(df)
        return scored.withColumn(out, weibull_cdf(F.col("scale"), F.lit(self.shape), F.lit(float(horizon))))


def fit_aft(df: DataFrame, features: Sequence[str], time: str = "time", event: str = "event") -> WeibullModel:
    """Weibull survival model on right-censored times.

    The likelihood takes the logarithm of time, so entities with no follow-up carry no
    information for it and are left out of training; they are still scored.
    """
    usable = df.where(F.col(time) > 0).withColumns(
        {"_time": F.col(time).cast("double"), "_observed": F.col(event).cast("double")}
    )
    aft = AFTSurvivalRegression(featuresCol="features", labelCol="_time", censorCol="_observed", maxIter=50)
    fitted = Pipeline(stages=[_assembler(features), aft]).fit(usable)
    return WeibullModel(fitted, 1.0 / fitted.stages[-1].scale)


def fit_hazard(
    person_period: DataFrame, features: Sequence[str], event: str = "period_event", weight: str | None = None
) -> PipelineModel:
    """Discrete-time hazard: logistic regression over person-periods.

    Include the period among ``features``, or one-hot columns of it for a free baseline.
    """
    lr = LogisticRegression(featuresCol="features", labelCol=event, maxIter=50)
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[_assembler(features), lr]).fit(person_period)


def cumulative_risk(model: PipelineModel, person_period: DataFrame, id: str, out: str = "score") -> DataFrame:
    """Risk by the end of the given periods, 1 - product(1 - hazard), one row per entity."""
    hazards = model.transform(person_period).select(id, vector_to_array("probability")[1].alias("_h"))
    return hazards.groupBy(id).agg((F.lit(1.0) - F.product(F.lit(1.0) - F.col("_h"))).alias(out))


def fit_pwe(
    person_period: DataFrame,
    features: Sequence[str],
    period: str = "period",
    event: str = "period_event",
    exposure: str = "exposure",
) -> PipelineModel:
    """Piecewise-exponential proportional hazards as a Poisson model with log exposure.

    Each period has its own baseline hazard. Its coefficients estimate those of a Cox model.
    There is no penalty, so that periods with few events are fitted as exactly as others: hazards
    are relative to the period with the most events, and those after the last one are as in the last.
    """
    rows = person_period.where(F.col(exposure) > 0)
    seen = rows.groupBy(period).agg(F.sum(event).alias("_n")).where(F.col(period).isNotNull()).collect()
    busiest = max(seen, key=lambda r: (r["_n"] or 0, -r[period]))[period] if seen else None
    last = max((r[period] for r in seen), default=None)
    each = {f"_period_{i}": f"{period} {'>=' if k == last else '='} {k}" for i, k in enumerate(sorted(r[period] for r in seen)) if k != busiest}
    stages = [
        SQLTransformer(
            statement=f"SELECT *, ln(CAST({exposure} AS DOUBLE)) AS _offset"
            + "".join(f", CAST({test} AS DOUBLE) AS {name}" for name, test in each.items()) + " FROM __THIS__"
        ),
        _assembler([*features, *each]),
        GeneralizedLinearRegression(
            family="poisson", link="log", featuresCol="features", labelCol=event, offsetCol="_offset",
            maxIter=25, regParam=0.0,
        ),
    ]
    return Pipeline(stages=stages).fit(rows)


def score_equations(df: DataFrame, observed: Column, fitted: Column, terms: Mapping[str, Column], tolerance: float = 1e-4) -> DataFrame:
    """(term, n, observed, fitted, gradient, is_met): whether a likelihood is at its maximum, from all rows in one pass.

    At the maximum of a likelihood whose gradient by a coefficient is the sum of (observed -
    fitted) * term, the two sums agree. ``gradient`` is their difference as a share of the sum of
    the observed sizes, or of the rows where nothing was observed; ``is_met`` tells whether that is within ``tolerance``. Rows without an
    observed or fitted value or a term are left out of that term.
    """
    sums = []
    for name, x in terms.items():
        o, f = observed * x, fitted * x
        known = o.isNotNull() & f.isNotNull()
        total = lambda c: F.coalesce(F.sum(F.when(known, c).cast("double")), F.lit(0.0))  # noqa: B023  used at once
        sums.append(F.struct(F.lit(name).alias("term"), F.count_if(known).alias("n"), total(o).alias("observed"), total(f).alias("fitted"), total(F.abs(o)).alias("_size")))
    rows = df.agg(F.array(*sums).alias("_t")).select(F.inline("_t"))
    gradient = F.try_divide(F.col("observed") - F.col("fitted"), F.when(F.col("_size") > 0, F.col("_size")).otherwise(F.col("n")))
    return rows.select("term", "n", "observed", "fitted", gradient.alias("gradient"), (F.abs(gradient) <= tolerance).cast("int").alias("is_met"))


def aft_equations(model: WeibullModel, df: DataFrame, features: Sequence[str], time: str = "time", event: str = "event", tolerance: float = 1e-4) -> DataFrame:
    """``score_equations`` of a Weibull model: events against exp(e), e the standardised log time, and for the shape e * (exp(e) - event)."""
    rows = model.transform(df.where(F.col(time) > 0)).withColumn("_e", F.log(F.col(time) / F.col("scale")) * F.lit(model.shape))
    d = F.col(event).cast("double")
    ends = score_equations(rows, d, F.exp("_e"), {"intercept": F.lit(1.0), **{c: F.col(c).cast("double") for c in features}}, tolerance)
    return ends.unionByName(score_equations(rows, d, F.col("_e") * (F.exp("_e") - d), {"shape": F.lit(1.0)}, tolerance))


def fit_gbt(
    df: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = None, seed: int = 7,
    max_iter: int = 20, max_depth: int = 4,
) -> PipelineModel:
    """Boosted trees for a fixed-horizon label (I4); rows with a null label are left out."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth, seed=seed)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return Pipeline(stages=[_assembler(features), gbt]).fit(df.where(F.col(label).isNotNull()))


def probability(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """Score rows with a fitted classifier; only the input columns and the score come back."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


def baseline_score(df: DataFrame, score: str | Column, out: str = "score") -> DataFrame:
    """Comparator: an external score column, or time since implant alone."""
    return df.withColumn(out, (F.col(score) if isinstance(score, str) else score).cast("double"))


def ensemble(preds: Sequence[DataFrame], weights: Sequence[float], id: str, score: str = "score") -> DataFrame:
    """Weighted mean of several models' scores per entity.

    The predictions are stacked and aggregated once, whatever the number of models. Where a
    model has no score its weight is left out of the mean.
    """
    stacked = None
    for pred, weight in zip(preds, weights, strict=True):
        one = pred.select(id, F.col(score).cast("double").alias("_s"), F.lit(float(weight)).alias("_w"))
        stacked = one if stacked is None else stacked.unionByName(one)
    stacked = stacked.where(F.col("_s").isNotNull())
    return stacked.groupBy(id).agg(
        F.try_divide(F.sum(F.col("_s") * F.col("_w")), F.sum("_w")).alias(score),
        F.count(F.lit(1)).alias("n_models"),
    )


def tune(estimator, grid, evaluator: Evaluator, df: DataFrame, fold: str, k: int, parallelism: int = 2) -> CrossValidatorModel:
    """Hyper-parameter search over folds grouped by entity (I7); make ``fold`` with ``splits.folds``."""
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, foldCol=fold,
                        numFolds=k, parallelism=parallelism)
    return cv.fit(df)


def top_contributions(
    df: DataFrame, coef: Mapping[str, float], means: Mapping[str, float], k: int, out: str = "top"
) -> DataFrame:
    """The ``k`` largest contributions coef * (x - mean) to a linear predictor, per row (I8).

    Exact for linear predictors with independent features; missing values contribute 0.
    """
    parts = [
        F.struct(
            F.lit(name).alias("feature"),
            F.coalesce(F.lit(float(b)) * (F.col(name).cast("double") - F.lit(float(means[name]))), F.lit(0.0)).alias(
                "contribution"
            ),
        )
        for name, b in coef.items()
    ]
    sized = F.transform(F.array(*parts), lambda s: F.struct((-F.abs(s["contribution"])).alias("o"), s["feature"].alias("f"), s["contribution"].alias("c")))
    ranked = F.slice(F.array_sort(sized), 1, k)
    return df.withColumn(
        out, F.transform(ranked, lambda s: F.struct(s["f"].alias("feature"), s["c"].alias("contribution")))
    )


def shuffled_column(df: DataFrame, id: str, column: str, seed: int, rows_per_bucket: int = 50_000) -> DataFrame:
    """``df`` with one column's values permuted among its rows.

    Rows fall into hash buckets and are permuted within them, so no global order is needed:
    in each bucket the n-th row by one hash receives the value of the n-th row by another.
    ``id`` must be unique per row.
    """
    n = df.count()
    buckets = max(1, -(-n // rows_per_bucket))
    keyed = df.withColumn("_b", bucket(id, buckets, f"{seed}b"))
    place = lambda salt: F.row_number().over(Window.partitionBy("_b").orderBy(hash32(id, f"{seed}{salt}"), id))
    source = keyed.select("_b", place("s").alias("_place"), F.col(column).alias("_value"))
    target = keyed.withColumn("_place", place("t"))
    mixed = target.join(source, ["_b", "_place"])
    return mixed.withColumn(column, F.col("_value")).select(*df.columns)


def perm_importance(
    model: PipelineModel, df: DataFrame, id: str, columns: Sequence[str], evaluator: Evaluator, seed: int = 11
) -> DataFrame:
    """Drop in a metric when each feature is shuffled.

    One scoring job per feature; the loop is over features, never over rows.
    """
    base = float(evaluator.evaluate(model.transform(df)))
    rows = []
    for column in columns:
        value = float(evaluator.evaluate(model.transform(shuffled_column(df, id, column, seed))))
        rows.append((column, base, value, base - value))
    return df.sparkSession.createDataFrame(
        rows, "feature STRING, base_metric DOUBLE, shuffled_metric DOUBLE, importance DOUBLE"
    )
