"""Properties that hold for any data."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import evaluation, privacy, splits, survival, temporal
from cohortlens.operators.endpoints import person_period

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
follow_up = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 2), st.integers(0, 5)), min_size=2, max_size=40)


def frame(spark, data):
    rows = [(i, t, c, int(c > 0), s / 5) for i, (t, c, s) in enumerate(data)]
    return spark.createDataFrame(rows, "id INT, time INT, cause INT, event INT, score DOUBLE")


@few
@given(follow_up)
def test_survival_falls_and_incidences_complete_it(spark, data):
    df = frame(spark, data)
    curve = [r.survival for r in survival.km(df).orderBy("time").collect()]
    assert all(0 <= b <= a <= 1 for a, b in zip([1.0, *curve], curve))
    total = survival.cif(df, [1, 2]).groupBy("time").agg(F.sum("incidence").alias("i")).orderBy("time").collect()
    assert [r.i for r in total] == pytest.approx([1 - s for s in curve])


@few
@given(follow_up)
def test_concordance_of_reversed_scores(spark, data):
    df = frame(spark, data)
    a = evaluation.cindex(df).first()
    b = evaluation.cindex(df.withColumn("score", -F.col("score"))).first()
    if a and a.comparable:
        assert a.c_index == pytest.approx(1 - b.c_index)


@few
@given(follow_up)
def test_person_periods_add_up(spark, data):
    df = frame(spark, data)
    long = person_period(df, "time", "event", 5)
    total = long.groupBy("id").agg(F.sum("exposure").alias("e"), F.sum("period_event").alias("d"))
    got = {r.id: (r.e, r.d) for r in total.collect()}
    assert got == {i: (t, int(c > 0)) for i, (t, c, _) in enumerate(data)}


@few
@given(st.sets(st.integers(0, 10_000), min_size=1, max_size=60))
def test_splits_are_stable_and_whole(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id INT")
    weights = {"train": 0.6, "test": 0.4}
    a = {r.id: r.split for r in splits.split_entity(df, "id", weights).collect()}
    b = {r.id: r.split for r in splits.split_entity(df.repartition(7).where("id % 2 = 0"), "id", weights).collect()}
    assert set(a) == ids and all(a[i] == s for i, s in b.items()) and set(a.values()) <= set(weights)
    k = {r.id: r.fold for r in splits.folds(df, "id", 3).collect()}
    assert set(k) == ids and set(k.values()) <= {0, 1, 2}


@few
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 50), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=30))
def test_carrying_forward_twice_changes_nothing(spark, data):
    rows = [(i, id, dt.date(2020, 1, 1) + dt.timedelta(days=d), x) for i, (id, d, x) in enumerate(data)]
    df = spark.createDataFrame(rows, "k INT, id INT, t DATE, x INT")
    once = temporal.locf(df, "id", ["t", "k"], "x").drop("x").withColumnRenamed("x_locf", "x")
    twice = temporal.locf(once, "id", ["t", "k"], "x")
    assert twice.where(~F.col("x").eqNullSafe(F.col("x_locf"))).count() == 0


@few
@given(st.lists(st.tuples(st.integers(1, 5), st.integers(0, 3000)), min_size=1, max_size=30))
def test_shifted_dates_keep_intervals(spark, data):
    rows = [(i, id, dt.date(2010, 1, 1) + dt.timedelta(days=d), dt.datetime(2010, 1, 1, 7) + dt.timedelta(days=d)) for i, (id, d) in enumerate(data)]
    df = spark.createDataFrame(rows, "k INT, id INT, a DATE, b TIMESTAMP")
    moved = privacy.shift_dates(df, "id", ["a", "b"], 30, "s").select("k", F.col("a").alias("a2"), F.col("b").alias("b2"))
    gaps = df.join(moved, "k").select("id", F.datediff("a2", "a").alias("d"), F.datediff("b2", "b").alias("e"))
    got = gaps.collect()
    assert all(r.d == r.e and abs(r.d) <= 30 for r in got)
    assert len({(r.id, r.d) for r in got}) == len({r.id for r in got})
