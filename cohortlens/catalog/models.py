"""Models trained on the stand-in cohort (group I)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.catalog import base
from cohortlens.catalog.base import r6, rd, sql
from cohortlens.operators import models
from cohortlens.operators.endpoints import horizon_value, person_period
from cohortlens.operators.splits import class_weights, folds
from cohortlens.plans.flows import landmark_features, train_and_evaluate
from cohortlens.plans.skew import skew_join
from cohortlens.session import materialized

HORIZON = 1826
COLUMNS = ["index_x", "balance", "n_early"]
COEF = {"index_x": -0.000004, "balance": 0.0001, "n_visits": 0.05}
MEANS = {"index_x": 250_000.0, "balance": 4_500.0, "n_visits": 10.0}


def _features(spark, d):
    """Baseline facts plus the number of visits in the first year, known at the landmark."""
    s = base.survival(spark, d)
    early = skew_join(base.visits(spark, d).select("id", "t"), s.select("id", "index_t"), "id").where(F.datediff("t", "index_t") <= 365)
    n = early.groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("n_early"))
    return materialized(s.join(n, "id").select("id", "segment", "site", "time", "event", *COLUMNS))


def _labelled(spark, d):
    f = _features(spark, d)
    f = f.withColumn("label", horizon_value(F.col("time"), F.col("event"), HORIZON).cast("double"))
    return materialized(class_weights(f.where(F.col("label").isNotNull()), "label"))


def _aft(spark, d):
    f = _features(spark, d)
    return models.fit_aft(f, COLUMNS).risk(f, HORIZON).select("id", "time", "event", "scale", "score")


def _periods(spark, d):
    return materialized(person_period(_features(spark, d), "time", "event", 365, HORIZON))


def _hazard(spark, d):
    rows = _periods(spark, d)
    model = models.fit_hazard(rows, [*COLUMNS, "period"])
    ahead = _features(spark, d).withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return models.cumulative_risk(model, ahead, "id")


def _pwe(spark, d):
    rows = _periods(spark, d)
    return models.fit_pwe(rows, COLUMNS).transform(rows).select("id", "period", F.col("prediction").alias("expected_events"))


def _met(equations):
    """Without the fitted sums, which are equal within the tolerance only."""
    return r6(equations.select("term", "n", "observed", "is_met"), 2)


def _terms():
    return {"intercept": F.lit(1.0), **{c: F.col(c).cast("double") for c in COLUMNS}}


def _aft_equations(spark, d):
    f = _features(spark, d)
    return _met(models.aft_equations(models.fit_aft(f, COLUMNS), f, COLUMNS))


def _hazard_equations(spark, d):
    rows = _periods(spark, d)
    scored = models.probability(models.fit_hazard(rows, [*COLUMNS, "period"]), rows)
    return _met(models.score_equations(scored, F.col("period_event"), F.col("score"), _terms() | {"period": F.col("period").cast("double")}))


def _pwe_equations(spark, d):
    """Of each period events against expected ones; and of each feature."""
    rows = _periods(spark, d).where("exposure > 0")
    scored = models.fit_pwe(rows, COLUMNS).transform(rows)
    each = {f"period {k}": F.when(F.col("period") == k, 1.0).otherwise(0.0) for k in range(-(-HORIZON // 365))}
    return _met(models.score_equations(scored, F.col("period_event"), F.col("prediction"), _terms() | each))


def _gbt(spark, d):
    rows = _labelled(spark, d)
    return models.probability(models.fit_gbt(rows, COLUMNS, weight="weight", max_iter=10), rows).select("id", "label", "score")


def _baseline(spark, d):
    return models.baseline_score(base.scored(spark, d).select("id", "other", "time"), "other")


def _ensemble(spark, d):
    s = base.scored(spark, d)
    a = s.select("id", "score")
    b = s.where("segment <> 'BUILDING'").select("id", F.col("other").alias("score"))
    return r6(models.ensemble([a, b], [0.7, 0.3], "id"))


def _tune(spark, d):
    rows = materialized(folds(_labelled(spark, d), "id", 3))
    rows = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(rows)
    lr = LogisticRegression(weightCol="weight", maxIter=20)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).addGrid(lr.elasticNetParam, [0.0, 0.5]).build()
    fitted = models.tune(lr, grid, BinaryClassificationEvaluator(), rows, "fold", 3)
    table = [(m[lr.regParam], m[lr.elasticNetParam], float(v)) for m, v in zip(grid, fitted.avgMetrics)]
    return spark.createDataFrame(table, "reg_param DOUBLE, elastic_net DOUBLE, auc DOUBLE")


def _contributions(spark, d):
    c = base.cohort(spark, d).select("id", "index_x", "balance", "n_visits")
    top = models.top_contributions(c, COEF, MEANS, 2)
    return r6(top.select("id", F.posexplode("top").alias("pos", "_t")).select("id", "pos", "_t.feature", "_t.contribution"))


def _importance(spark, d):
    rows = _labelled(spark, d)
    return models.perm_importance(models.fit_hazard(rows, COLUMNS, "label", "weight"), rows, "id", COLUMNS, BinaryClassificationEvaluator())


def _flow(spark, d):
    """Landmark features, split, fit on train, score and evaluate on test."""
    v = base.visits(spark, d).select("id", "t", "vk", "x")
    rows = landmark_features(v, base.survival(spark, d).select("id", "site", "balance", "index_t", "index_x", "time", "event"),
                             id="id", order=["t", "vk"], x="x", index="index_t", landmark=365)
    columns = ["index_x", "balance", "slope_per_year", "latest", "n_measures"]
    _, _, metrics = train_and_evaluate(rows, columns, id="id", horizon=1461)
    c, a, b = metrics["concordance"], metrics["auc"], metrics["calibration"]
    long = lambda df, name, n, value, of="NULL": df.selectExpr(f"'{name}' AS metric", f"CAST({of} AS INT) AS bin", f"CAST({n} AS BIGINT) AS n", f"{value} AS value")
    parts = [long(c, "concordance", "comparable", "c_index"), long(a, "auc", "n_cases + n_controls", "auc"), long(b, "predicted", "n", "predicted", "bin"), long(b, "observed", "n", "observed", "bin")]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    "I1_fit_aft": _aft,
    "I2_fit_hazard": _hazard,
    "I3_fit_pwe": _pwe,
    "I1_aft_equations": _aft_equations,
    "I2_hazard_equations": _hazard_equations,
    "I3_pwe_equations": _pwe_equations,
    "I4_fit_gbt": _gbt,
    "I5_baseline_score": _baseline,
    "I6_ensemble": _ensemble,
    "I7_tune": _tune,
    "I8_top_contributions": _contributions,
    "I9_perm_importance": _importance,
    "flow_train_and_evaluate": _flow,
}

_TERMS = " UNION ALL ".join(
    f"SELECT id, '{c}' AS feature, ({b!r}::DOUBLE) * (CAST({c} AS DOUBLE) - {MEANS[c]!r}::DOUBLE) AS v FROM coh" for c, b in COEF.items()
)

_FEAT = (
    "SELECT s.id, time, event, CAST(index_x AS DOUBLE) AS index_x, CAST(balance AS DOUBLE) AS balance, n_early FROM surv s JOIN "
    "(SELECT v.id, CAST(count(*) AS DOUBLE) AS n_early FROM v JOIN surv USING (id) WHERE date_diff('day', index_t, v.t) <= 365 GROUP BY v.id) USING (id)"
)
_ENDS = f"SELECT *, least(greatest(time, 0), {HORIZON}) AS stop, CASE WHEN time <= {HORIZON} THEN event ELSE 0 END AS had FROM feat"
_PP = (
    "SELECT *, CASE WHEN period = last THEN had ELSE 0 END AS y, least(stop, (period + 1) * 365) - period * 365 AS exposure FROM "
    "(SELECT *, unnest(range(0, last + 1)) AS period FROM (SELECT *, CASE WHEN stop > 0 AND stop % 365 = 0 THEN stop // 365 - 1 ELSE stop // 365 END AS last FROM stops))"
)


def _equations(rows: str, y: str, terms: dict[str, str]) -> str:
    """What the sums over the observed values must be, every equation being met."""
    return " UNION ALL ".join(
        f"SELECT '{t}' AS term, count(*) AS n, {rd(f'sum(CAST({y} AS DOUBLE) * {x} ORDER BY id)', 2)} AS observed, CAST(1 AS INTEGER) AS is_met FROM {rows}" for t, x in terms.items()
    )


_TERM_SQL = {"intercept": "1.0::DOUBLE", **{c: c for c in COLUMNS}}

SQL = {
    "I1_aft_equations": sql("surv v", _equations("(SELECT * FROM feat WHERE time > 0)", "event", _TERM_SQL | {"shape": "1.0::DOUBLE"}), feat=_FEAT),
    "I2_hazard_equations": sql("surv v", _equations("pp", "y", _TERM_SQL | {"period": "CAST(period AS DOUBLE)"}), feat=_FEAT, stops=_ENDS, pp=_PP),
    "I3_pwe_equations": sql(
        "surv v",
        _equations("(SELECT * FROM pp WHERE exposure > 0)", "y", _TERM_SQL | {f"period {k}": f"CAST(period = {k} AS DOUBLE)" for k in range(-(-HORIZON // 365))}),
        feat=_FEAT, stops=_ENDS, pp=_PP,
    ),
    "I5_baseline_score": sql("scor", "SELECT id, other, time, other AS score FROM scor"),
    "I6_ensemble": sql(
        "scor",
        f"SELECT id, {rd('''CASE WHEN segment = 'BUILDING' THEN score * 0.7 / 0.7 ELSE score * 0.7 + other * 0.3 END''')} AS score, "
        "CAST(CASE WHEN segment = 'BUILDING' THEN 1 ELSE 2 END AS BIGINT) AS n_models FROM scor",
    ),
    "I8_top_contributions": sql(
        "coh",
        f"SELECT id, CAST(k - 1 AS INTEGER) AS pos, feature, {rd('v')} AS contribution FROM "
        "(SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(v) DESC, feature) AS k FROM terms) WHERE k <= 2",
        terms=_TERMS,
    ),
}
