"""Plans for entities too big for one task give what the ordinary plans give.

One entity holds a third of all rows, one group has no id, and the row limit per task is
set so low that both are split.
"""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cohort, endpoints, evaluation, features, temporal
from cohortlens.operators.cleaning import availability
from cohortlens.plans.quantiles import exact_quantile
from cohortlens.plans.scan import ordered_scan
from cohortlens.plans.skew import hot_keys, lookup_join, skew_join

LIMIT = 7


@pytest.fixture(scope="module")
def visits(spark):
    random.seed(1)
    start, data = dt.datetime(2015, 1, 1), []
    for k in range(300):
        id = 1 if k % 3 == 0 else None if k % 10 == 1 else random.randint(2, 25)
        t = start + dt.timedelta(days=random.randint(0, 400), hours=random.randint(0, 3))
        x = None if random.random() < 0.3 else round(random.uniform(0, 100), 1)
        data.append((id, t, k, x, int(random.random() < 0.5)))
    return spark.createDataFrame(data, "id INT, t TIMESTAMP, vk INT, x DOUBLE, flag INT").cache()


@pytest.fixture(scope="module")
def index(visits):
    return cohort.index_event(visits.where("id IS NOT NULL"), "id", "t", ["x"], "vk").cache()


def same(a, b):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    left = sorted((tuple(r) for r in a.select(*sorted(a.columns)).collect()), key=key)
    right = sorted((tuple(r) for r in b.select(*sorted(b.columns)).collect()), key=key)
    assert len(left) == len(right) > 0
    for p, q in zip(left, right):
        assert p == pytest.approx(q) if all(isinstance(v, (int, float)) for v in p) else p == q


def test_hot_keys_are_found(visits):
    table, small = hot_keys(visits, "id", LIMIT)
    ids = [r.id for r in table.collect()]
    assert small and 1 in ids and None in ids
    assert hot_keys(visits, "id") is None


def test_ordered_scan(visits):
    v = visits.withColumn("one", F.lit(1))
    how = dict(prev={"pt": "t", "px": "x"}, carry={"cx": "x"}, running={"n": "one", "sx": "flag"})
    same(ordered_scan(v, "id", ["t", "vk"], **how), ordered_scan(v, "id", ["t", "vk"], group_rows=LIMIT, **how))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(visits, index, how):
    some = index.where("id % 2 = 1").select("id", "index_x")
    same(visits.join(some, "id", how), skew_join(visits, some, "id", how, LIMIT))


def test_skew_join_refuses_other_kinds(visits, index):
    with pytest.raises(ValueError):
        skew_join(visits, index, "id", "full")


def test_lookup_join(visits, index):
    same(visits.join(index.select("id", "index_x"), "id", "left"), lookup_join(visits, index.select("id", "index_x"), "id"))


@pytest.mark.parametrize("age", [None, 20])
def test_locf(visits, age):
    same(temporal.locf(visits, "id", ["t", "vk"], "x", age), temporal.locf(visits, "id", ["t", "vk"], "x", age, LIMIT))


def test_visit_gaps(visits):
    v = visits.select("id", "t", "vk")
    same(temporal.visit_gaps(v, "id", ["t", "vk"], 60), temporal.visit_gaps(v, "id", ["t", "vk"], 60, LIMIT))


def test_visit_rate(visits):
    same(features.visit_rate(visits, "id", ["t", "vk"], "x"), features.visit_rate(visits, "id", ["t", "vk"], "x", LIMIT))


@pytest.mark.parametrize("tolerance", [None, 10])
def test_asof(visits, tolerance):
    left, right = visits.where("vk % 2 = 0").select("id", "t", "vk"), visits.where("vk % 2 = 1").select("id", "t", "vk", "x")
    how = dict(by="id", t="t", left_order=["vk"], right_order=["vk"], tolerance_days=tolerance)
    same(temporal.asof(left, right, **how), temporal.asof(left, right, group_rows=LIMIT, **how))


@pytest.mark.parametrize("confirm", [0, 1, 3])
def test_first_event(visits, confirm):
    plain = endpoints.first_event(visits, "id", ["t", "vk"], "flag", confirm)
    same(plain, endpoints.first_event(visits, "id", ["t", "vk"], "flag", confirm, group_rows=LIMIT))


@pytest.mark.parametrize("how", ["nearest", "last"])
def test_value_at(visits, index, how):
    args = dict(id="id", t="t", index="index_t", x="x", horizons=[90, 180, 365], back=60, ahead=60, how=how, tiebreak="vk")
    same(temporal.value_at(visits, index, **args), temporal.value_at(visits, index, group_rows=LIMIT, **args))


def test_missed_visits(visits, index):
    grid = temporal.visit_grid(index, "id", "index_t", 60, 360)
    args = dict(id="id", t="t", index="index_t", every_days=60, tol_days=10)
    same(temporal.missed_visits(grid, visits, index, **args), temporal.missed_visits(grid, visits, index, group_rows=LIMIT, **args))


def test_from_baseline(visits, index):
    args = dict(id="id", x="x", baseline="index_x")
    same(features.from_baseline(visits, index, **args), features.from_baseline(visits, index, group_rows=LIMIT, **args))


def test_availability(visits, index):
    c = index.withColumn("site", F.col("id") % 3)
    args = dict(id="id", t="t", index="index_t", horizon_days=180, tol_days=40, min_share=0.5, by="site")
    same(availability(visits, c, **args), availability(visits, c, group_rows=LIMIT, **args))


def test_exclude_history(visits, index):
    ev = visits.withColumn("kind", F.lit("bad"))
    args = dict(id="id", index="index_t", t="t", kind="kind", kinds=["bad"], before_days=0, after_days=0)
    assert cohort.exclude_history(index, ev, **args).count() == 0
    args["after_days"] = -1
    same(cohort.exclude_history(index, ev, **args), cohort.exclude_history(index, ev, group_rows=LIMIT, **args))


def test_detection_delay(visits):
    crossed = visits.where("flag = 1 AND id IS NOT NULL").select("id", "t")
    args = dict(id="id", crossed_t="t", detected_t="t")
    acted = visits.where("flag = 0 AND id IS NOT NULL").select("id", "t")
    same(evaluation.detection_delay(crossed, acted, **args), evaluation.detection_delay(crossed, acted, group_rows=LIMIT, **args))


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.77, 1.0])
def test_exact_quantile(visits, q):
    plain = visits.groupBy("id").agg(F.percentile("x", q).alias("quantile")).where("quantile IS NOT NULL")
    same(plain, exact_quantile(visits, "x", q, ["id"]))
    same(plain, exact_quantile(visits, "x", q, ["id"], group_rows=3, bins=4))
    whole = visits.agg(F.percentile("x", q).alias("quantile"))
    same(whole, exact_quantile(visits, "x", q, [], group_rows=3, bins=4))


def test_quantile_of_heavy_ties(spark):
    df = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 50, "x DOUBLE")
    assert exact_quantile(df, "x", 0.5, group_rows=5, bins=4).first().quantile == 1.5


def test_two_level_ranks(spark, monkeypatch):
    random.seed(5)
    data = [(i, random.randint(1, 40), random.randint(0, 1), round(random.uniform(-3, 3), 2)) for i in range(300)]
    df = spark.createDataFrame(data, "id INT, time INT, event INT, score DOUBLE")
    plain, auc = evaluation.cindex(df), evaluation.td_auc(df, 20).first().auc
    brute = [0, 0, 0]
    for a in data:
        for b in data:
            if a[2] == 1 and (a[1] < b[1] or (a[1] == b[1] and b[2] == 0)):
                brute[0] += a[3] > b[3]
                brute[1] += a[3] == b[3]
                brute[2] += 1
    assert [int(v) for v in plain.first()[:3]] == brute
    monkeypatch.setattr(evaluation, "WINDOW_SPAN", 10)
    assert [int(v) for v in evaluation.cindex(df).first()[:3]] == brute
    assert evaluation.td_auc(df, 20).first().auc == pytest.approx(auc)


def test_time_to_crossing(visits, index):
    from cohortlens.plans.flows import time_to_crossing

    people = index.select("id", (F.col("id") % 2).alias("g"))
    twice = visits.where("x IS NOT NULL").unionByName(visits.where("x IS NOT NULL AND vk % 2 = 0"))
    args = dict(id="id", order=["t", "vk"], x="x", rise=20.0, level=60.0, keep=["g"])
    same(time_to_crossing(twice, people, **args), time_to_crossing(twice, people, group_rows=LIMIT, **args))


@pytest.mark.parametrize("span", [10, 1_000_000])
def test_rows_without_a_stratum_form_one(spark, monkeypatch, span):
    random.seed(6)
    data = [(i, random.randint(1, 30), random.randint(0, 1), round(random.random(), 2), i % 3 or None) for i in range(200)]
    df = spark.createDataFrame(data, "id INT, time INT, event INT, score DOUBLE, site INT")
    named = df.withColumn("site", F.coalesce("site", F.lit(9)))
    monkeypatch.setattr(evaluation, "WINDOW_SPAN", span)
    for metric in (
        lambda d: evaluation.cindex(d, by="site"),
        lambda d: evaluation.td_auc(d, 15, by="site"),
        lambda d: evaluation.calibration(d, "score", 15, bins=3, by="site"),
    ):
        got = metric(df).withColumn("site", F.coalesce("site", F.lit(9)))
        same(got.select(*[F.col(c).cast("double") for c in got.columns]), metric(named).select(*[F.col(c).cast("double") for c in got.columns]))


def test_one_instant_holding_most_rows_is_cut(spark):
    from cohortlens.plans.scan import SEG, segment

    start = dt.datetime(2020, 1, 1)
    data = [(1, start, k, float(k) if k % 3 else None) for k in range(100)]
    data += [(1, start + dt.timedelta(days=k), 100 + k, float(k)) for k in range(20)]
    df = spark.createDataFrame(data, "id INT, t TIMESTAMP, vk INT, x DOUBLE")
    cut = segment(df, ["id"], ["t", "vk"], hot_keys(df, "id", LIMIT), LIMIT)
    sizes = [r["count"] for r in cut.groupBy(SEG).count().collect()]
    assert sum(sizes) == 120 and max(sizes) <= 2 * LIMIT
    same(temporal.locf(df, "id", ["t", "vk"], "x"), temporal.locf(df, "id", ["t", "vk"], "x", None, LIMIT))
    left, right = df.where("vk % 2 = 0").select("id", "t", "vk"), df.where("vk % 2 = 1").select("id", "t", "vk", "x")
    how = dict(by="id", t="t", left_order=["vk"], right_order=["vk"])
    same(temporal.asof(left, right, **how), temporal.asof(left, right, group_rows=LIMIT, **how))


@pytest.mark.parametrize("kind", ["outlier", "fractions", "strings", "equal"])
def test_segments_are_even_however_the_order_lies(spark, kind):
    """One far value, fractions with a text after them, texts alone, rows equal in the whole order."""
    from cohortlens.plans.scan import SEG, segment

    value = {
        "outlier": lambda k: (1e15 if k == 7 else float(k % 500), str(k)),
        "fractions": lambda k: (k % 5 / 10, f"n{k:04d}"),
        "strings": lambda k: (0.0, f"{k * 7919 % 1000:03d}-{k}"),
        "equal": lambda k: (1.0, "same"),
    }[kind]
    data = [(1, *value(k), float(k) if k % 3 else None) for k in range(1000)] + [(None, *value(k), 1.0) for k in range(300)] + [(2, 0.0, "cold", 5.0)]
    df = spark.createDataFrame(data, "id INT, t DOUBLE, vk STRING, x DOUBLE").repartition(5)
    cut = segment(df, ["id"], ["t", "vk"], hot_keys(df, "id", 50), 50)
    sizes = {(r["id"], r[SEG]): r["count"] for r in cut.groupBy("id", SEG).count().collect()}
    assert sorted(sizes.values()) == [50] * 26 and sum(k[0] is None for k in sizes) == 6
    how = dict(prev={"p": "x"}, carry={"c": "x"}, running={"r": "x"})
    plain, split = (ordered_scan(df, "id", ["t", "vk"], group_rows=g, **how) for g in (None, 50))
    if kind == "equal":  # any order is right: the last sums are the same
        plain, split = (d.groupBy("id").agg(F.max("r").alias("r"), F.count("p").alias("n"), F.count("c").alias("m")) for d in (plain, split))
        plain, split = plain.drop("m"), split.drop("m")
    same(plain, split)


def test_cold_rows_keep_one_shuffle(spark):
    """With a hot key, the branch of the other rows has the exchange of its window and no other."""
    from tests.test_plans import exchanges, plan

    df = spark.createDataFrame([(1, k, float(k)) for k in range(200)] + [(k, 0, 1.0) for k in range(2, 50)], "id INT, t INT, x DOUBLE")
    out = ordered_scan(df, "id", ["t"], carry={"c": "x"}, group_rows=20)
    text = plan(out)
    cold = text.split("\n\n")[0].split("Union")[1]
    first = cold.index("LeftAnti") if "LeftAnti" in cold else cold.index("Anti")
    assert cold[:first].count("Exchange") <= 2 and exchanges(text) >= 1
