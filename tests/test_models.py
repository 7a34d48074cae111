"""Fitted models are at the maximum of their likelihoods."""

from pyspark.sql import functions as F

from cohortlens.operators import models


def test_a_period_with_few_events_is_fitted_as_exactly_as_others(spark):
    """Period 0 has 2,000 events and period 1 has one: expected events equal them in each, and an unfitted later period has the last one's hazard."""
    rows = spark.range(20_000).select(
        (F.col("id") % 2).cast("int").alias("period"), (F.col("id") % 7).cast("double").alias("x"), F.lit(365).alias("exposure"),
        F.when(F.col("id") % 2 == 0, F.col("id") % 10 == 0).otherwise(F.col("id") == 1).cast("int").alias("period_event"),
    )
    model = models.fit_pwe(rows, ["x"])
    each = {f"period {k}": F.when(F.col("period") == k, 1.0).otherwise(0.0) for k in range(2)}
    got = models.score_equations(model.transform(rows), F.col("period_event"), F.col("prediction"), {"x": F.col("x"), **each}).collect()
    assert {r.term: r.observed for r in got}["period 0"] == 2000.0 and {r.term: r.observed for r in got}["period 1"] == 1.0
    assert all(r.is_met for r in got)
    later = rows.where("period = 1 and x = 0").limit(1)
    of = lambda df: model.transform(df).first()["prediction"]
    assert of(later.withColumn("period", F.lit(5))) == of(later)


def test_a_period_without_events_is_no_obstacle(spark):
    rows = spark.range(900).select(
        (F.col("id") % 3).cast("int").alias("period"), (F.col("id") % 5).cast("double").alias("x"), F.lit(10).alias("exposure"),
        ((F.col("id") % 3 < 2) & (F.col("id") % 4 == 0)).cast("int").alias("period_event"),
    )
    fitted = models.fit_pwe(rows, ["x"]).transform(rows).groupBy("period").agg(F.sum("prediction").alias("p"), F.sum("period_event").alias("o")).collect()
    assert len(fitted) == 3 and all(abs(r.p - r.o) < 1e-4 for r in fitted)
