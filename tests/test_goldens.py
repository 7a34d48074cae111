"""Results worked out by hand."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import clinical
from cohortlens.operators import cleaning, cohort, endpoints, evaluation, features, models, privacy, scorecard, scoring, survival, temporal

FIVE = [(1, 1, 1), (2, 2, 0), (3, 3, 1), (4, 4, 1), (5, 5, 0)]


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame(FIVE, "id INT, time INT, event INT")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_kaplan_meier(five):
    got = {r.time: r.survival for r in survival.km(five).collect()}
    assert got[1] == pytest.approx(0.8)
    assert got[3] == pytest.approx(0.533333, abs=1e-6)
    assert got[4] == pytest.approx(0.266667, abs=1e-6)
    assert got[5] == got[4]


def test_kaplan_meier_reaches_zero(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (2, 1)], "time INT, event INT")
    curve = survival.km_ci(df).orderBy("time").collect()
    assert curve[1].survival == 0.0
    assert curve[1].std_error is None and curve[1].lower is None


def test_time_must_be_whole(spark):
    with pytest.raises(TypeError):
        survival.km(spark.createDataFrame([(1.5, 1)], "time DOUBLE, event INT"))


def test_nelson_aalen(five):
    got = [r.cum_hazard for r in survival.nelson_aalen(five).orderBy("time").collect()]
    assert [got[0], got[2], got[3]] == pytest.approx([0.2, 0.533333, 1.033333], abs=1e-6)


def test_incidence(five):
    r = cohort.incidence(five, "time", "event", unit="years").first()
    assert (r.n_events, r.person_years, r.rate) == (3, 15.0, pytest.approx(0.2))


def test_concordance(five):
    r = evaluation.cindex(five.withColumn("score", (F.lit(6) - F.col("id")).cast("double"))).first()
    assert (r.comparable, r.concordant, r.tied, r.c_index) == (7, 7, 0, 1.0)


def test_concordance_tie(spark):
    df = spark.createDataFrame([(2, 1, 1.0), (2, 0, 1.0)], "time INT, event INT, score DOUBLE")
    r = evaluation.cindex(df).first()
    assert (r.comparable, r.tied, r.c_index) == (1, 1, 0.5)


def test_horizon_label(five):
    got = [r.label for r in endpoints.horizon_label(five, [3]).orderBy("id").collect()]
    assert got == [1, None, 1, 0, 0]


def test_locf(spark):
    day = dt.date(2020, 1, 1)
    data = [(1, day + dt.timedelta(days=i), x) for i, x in enumerate([None, 7.0, None, 9.0, None])]
    df = spark.createDataFrame(data, "id INT, t DATE, x DOUBLE")
    got = [r.x_locf for r in temporal.locf(df, "id", ["t"], "x").orderBy("t").collect()]
    assert got == [None, 7.0, 7.0, 9.0, 9.0]


def test_units(spark):
    df = spark.createDataFrame([(13.5951, "cmH2O"), (4.0, "mmHg"), (1.0, "bar"), (None, "mmHg")], "x DOUBLE, unit STRING")
    got = cleaning.normalize_units(df, "x", "unit", clinical.PRESSURE_TO_MMHG, "mmHg").collect()
    assert got[0].x == pytest.approx(10.0) and got[0].unit == "mmHg"
    assert got[1].x == 4.0
    assert got[2].x is None and got[2].unit == "bar" and got[2].x_unit_unknown == 1
    assert got[3].x is None and got[3].x_unit_unknown == 0


def test_index_and_mismatch(spark):
    df = spark.createDataFrame([(1.2, 2.0, 25.0), (1.2, 2.0, 32.0), (1.2, 0.0, 32.0)], "area DOUBLE, bsa DOUBLE, bmi DOUBLE")
    df = features.indexed(df, "area", "bsa").withColumn("stratum", clinical.bmi_stratum("bmi"))
    got = features.mismatch(df, "area_indexed", "stratum", clinical.MISMATCH_LIMITS).collect()
    assert [r.area_indexed for r in got] == [0.6, 0.6, None]
    assert [r.mismatch for r in got] == ["severe", "moderate", None]


def test_body_size(spark):
    r = spark.range(1).select(
        clinical.bsa_mosteller(F.lit(180.0), F.lit(80.0)).alias("m"), clinical.bsa_dubois(F.lit(180.0), F.lit(80.0)).alias("d"),
        clinical.bmi(F.lit(200.0), F.lit(80.0)).alias("b"),
    ).first()
    assert r.m == pytest.approx(2.0) and r.d == pytest.approx(1.996, abs=1e-3) and r.b == pytest.approx(20.0)


def test_score_card(spark):
    names = list(scorecard.CRITERION_WEIGHTS)
    data = [("a", n, s) for n, s in zip(names, (4, 3, 5, 2, 4))]
    data += [("b", n, 6 if i == 0 else 3) for i, n in enumerate(names)]
    data += [("c", n, 3) for n in names[:4]]
    data += [("d", n, 3) for n in [*names, names[0]]]
    data += [("e", n, 5) for n in names] + [("f", n, 5) for n in names]
    got = {r.entity: r for r in scorecard.scorecard(spark.createDataFrame(data, "entity STRING, criterion STRING, score INT")).collect()}
    assert got["a"].weighted_score == Decimal("3.65") and got["a"].is_valid == 1
    assert [got[k].is_valid for k in "bcd"] == [0, 0, 0]
    assert got["b"].n_rejected == 1 and got["b"].weighted_score is None
    ranked = rows(scorecard.rank_cards(spark.createDataFrame(list(got.values()))).select("entity", "rank", "dense_rank"), "entity")
    assert ranked == [("a", 3, 2), ("e", 1, 1), ("f", 1, 1)]


def test_score_card_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        scorecard.scorecard(spark.createDataFrame([], "entity STRING, criterion STRING, score INT"), {"x": Decimal("0.9")})


def test_stage_needs_corroboration(spark):
    df = spark.createDataFrame(
        [(1, 25.0, 15.0, 1.0, 1.4), (2, 35.0, 25.0, 0.7, 1.4), (3, 35.0, 25.0, None, 1.4), (4, None, None, 0.7, 1.4), (5, 25.0, 15.0, 1.4, 1.4)],
        "id INT, x DOUBLE, change DOUBLE, eoa DOUBLE, eoa0 DOUBLE",
    )
    got = endpoints.stage(df, x="x", change="change", corroborating="eoa", baseline_corroborating="eoa0", rules=clinical.STAGE_RULES)
    assert [r.stage for r in got.orderBy("id").collect()] == [2, 3, 0, None, 0]


def test_text_measures(spark):
    text = "Mean gradient 12.5 mmHg, later mean gradient 19 mmHg; peak velocity 2,8 m/s."
    df = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "id INT, report STRING")
    patterns = {"gradient": r"gradient ([0-9.,]+) mmHg", "velocity": r"velocity ([0-9.,]+) m/s"}
    got = rows(cleaning.extract_measures(df, "report", patterns, ["id"]), "measure", "position")
    assert got == [(1, "gradient", 1, 12.5), (1, "gradient", 2, 19.0), (1, "velocity", 1, 2.8)]


def test_masking(spark):
    text = "Write a.b@x.org or +1 (830) 555-5433, host 10.0.0.12."
    r = privacy.mask_text(spark.createDataFrame([(text,)], "t STRING"), "t").first()
    assert r.t == "Write [EMAIL] or [PHONE], host [IP]."
    assert (r.n_email, r.n_phone, r.n_ip) == (1, 1, 1)


def test_risk_table(spark):
    df = spark.createDataFrame([(1, 10.0)], "id INT, scale DOUBLE")
    risk = scoring.risk_table(df, [5, 10], "id", "scale", 1.0).first().risk
    assert [r.horizon for r in risk] == [5, 10]
    assert [r.prob for r in risk] == pytest.approx([0.393469, 0.632121], abs=1e-6)


def test_contributions(spark):
    df = spark.createDataFrame([(2.0, 1.0, None)], "a DOUBLE, b DOUBLE, c DOUBLE")
    top = models.top_contributions(df, {"a": 1.0, "b": -3.0, "c": 9.0}, {"a": 1.0, "b": 0.0, "c": 0.0}, 2).first().top
    assert [(t.feature, t.contribution) for t in top] == [("b", -3.0), ("a", 1.0)]


def test_logrank_by_hand(spark):
    data = [("a", 1, 1), ("a", 3, 1), ("b", 2, 1), ("b", 4, 0)]
    got = rows(survival.logrank(spark.createDataFrame(data, "g STRING, time INT, event INT"), "g", ["a", "b"]), "g")
    # Expected for a: 2/4 + 1/3 + 1/2; variance: 1/4 + 2/9 + 1/4.
    assert got[0][1] == 2 and got[0][2] == pytest.approx(4 / 3)
    assert got[0][3] == pytest.approx((2 - 4 / 3) ** 2 / (13 / 18))


def test_logrank_many_matches_two(spark):
    data = [("a", 1, 1), ("a", 3, 1), ("b", 2, 1), ("b", 4, 0), ("c", 2, 1), ("c", 5, 1)]
    df = spark.createDataFrame(data, "g STRING, time INT, event INT")
    two = survival.logrank(df, "g", ["a", "b"]).first().chi2
    assert survival.logrank(df.where("g <> 'c'"), "g", ["a", "b"]).first().chi2 == pytest.approx(two)
    three = survival.logrank(df, "g", ["a", "b", "c"])
    assert three.first().df == 2 and three.first().chi2 > 0


def test_logrank_of_all_segments_is_registered(spark):
    import __spark_entry__
    from cohortlens.catalog import base

    got = __spark_entry__.queries()["H5_logrank_all"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.segment for r in got) == sorted(base.SEGMENTS) and {r.df for r in got} == {4}
    assert sum(r.observed for r in got) == pytest.approx(sum(r.expected for r in got))


def test_auc_against_brute_force(spark):
    import random

    random.seed(3)
    data = [(i, random.randint(1, 30), random.randint(0, 1), round(random.random(), 2)) for i in range(120)]
    df = spark.createDataFrame(data, "id INT, time INT, event INT, score DOUBLE")
    g, at_risk = {}, {t: sum(x[1] >= t for x in data) for t in range(1, 31)}
    value = 1.0
    for t in range(1, 31):
        g[t] = value
        d = sum(x[1] == t and x[2] == 1 for x in data)
        c = sum(x[1] == t and x[2] == 0 for x in data)
        if at_risk[t] > d:
            value *= 1 - c / (at_risk[t] - d)
    cases = [x for x in data if x[1] <= 15 and x[2] == 1]
    controls = [x for x in data if x[1] > 15]
    won = sum((a[3] > b[3]) / g[a[1]] + 0.5 * (a[3] == b[3]) / g[a[1]] for a in cases for b in controls)
    total = sum(1 / g[a[1]] for a in cases) * len(controls)
    assert evaluation.td_auc(df, 15).first().auc == pytest.approx(won / total)


def test_calibration_bins_hold_all_rows(spark):
    df = spark.createDataFrame([(i, i % 7 + 1, i % 2, (i % 10) / 10) for i in range(100)], "id INT, time INT, event INT, p DOUBLE")
    got = evaluation.calibration(df, "p", 4, bins=4).collect()
    assert sum(r.n for r in got) == 100 and len(got) == 4


def test_leakage_report_is_empty_for_a_sound_split(spark):
    from cohortlens.operators.splits import leakage, split_entity

    df = spark.createDataFrame([(i % 20, i) for i in range(200)], "id INT, v INT")
    assert leakage(split_entity(df, "id", {"a": 0.5, "b": 0.5}), "id", "split").count() == 0
    assert leakage(split_entity(df, "v", {"a": 0.5, "b": 0.5}), "id", "split").count() == 20


GAPS = [(1, None, 1), (2, 1, 1), (3, 2, 0), (4, 3, 1), (5, 2, None)]


def test_missing_times_and_events_are_left_out(spark):
    df = spark.createDataFrame([(*r, "a") for r in GAPS], "id INT, time INT, event INT, g STRING")
    full = df.dropna()
    for estimate in (survival.km, survival.km_ci, survival.nelson_aalen, survival.ipcw):
        assert sorted(estimate(df).collect()) == sorted(estimate(full).collect())
    assert survival.surv_at(survival.km(df), [1]).first().survival == pytest.approx(2 / 3)
    causes = lambda d: survival.cif(d.withColumnRenamed("event", "cause"), [1])
    assert sorted(causes(df).collect()) == sorted(causes(full).collect())
    two = df.unionByName(full.withColumns({"g": F.lit("b"), "time": F.col("time") + 1}))
    assert sorted(survival.logrank(two, "g", ["a", "b"]).collect()) == sorted(survival.logrank(two.dropna(), "g", ["a", "b"]).collect())
    assert survival.left_out(df).first().asDict() == {"n_left_out": 2, "n_rows": 5}


def test_person_periods_of_odd_times(spark):
    df = spark.createDataFrame([(1, None, 1), (2, -5, 1), (3, 31, 1), (4, 30, 0)], "id INT, time INT, event INT")
    got = {(r.id, r.period): (r.exposure, r.period_event) for r in endpoints.person_period(df, "time", "event", 30).collect()}
    assert got == {(1, None): (None, None), (2, 0): (0, 1), (3, 0): (30, 0), (3, 1): (1, 1), (4, 0): (30, 0)}


def test_scores_are_compared_exactly(spark, monkeypatch):
    rows = [(i, i + 1, 1, (1000 - i) * 1e-6) for i in range(1000)]
    df = spark.createDataFrame(rows, "id INT, time INT, event INT, score DOUBLE")
    for span in (1_000_000, 16):  # in one window, and by ranks in chunks
        monkeypatch.setattr(evaluation, "WINDOW_SPAN", span)
        assert evaluation.cindex(df).first().c_index == 1.0 and evaluation.td_auc(df, 500).first().auc == pytest.approx(1.0)
        assert sorted(r.n for r in evaluation.calibration(df, "score", 500, bins=4).collect()) == [250] * 4
    assert evaluation.cindex(df, digits=4).first().c_index < 0.96


def test_concordance_of_negative_times(spark):
    df = spark.createDataFrame([(-5, 1, 3.0), (2, 1, 2.0), (4, 1, 1.0)], "time INT, event INT, score DOUBLE")
    r = evaluation.cindex(df).first()
    assert (int(r.comparable), r.c_index) == (3, 1.0)
