"""Bootstrap of rank metrics and the Brier score against every pair in plain Python, replicate by replicate."""

import hashlib
import random

import pytest

from cohortlens.operators import evaluation as ev
from cohortlens.operators import models

HORIZON, REPS = 12, 7


def weight(id, r):
    u = int(hashlib.md5(f"boot{r}:{id}".encode()).hexdigest()[:8], 16) / 2**32
    return sum(u >= e for e in ev.poisson_edges())


def rows():
    rng = random.Random(4)
    made = [(i, rng.randint(-2, 20), rng.randint(0, 1), rng.choice([0.1, 0.2, 0.5, rng.random()]), rng.random()) for i in range(60)]
    return made + [(90, None, 1, 0.5, 0.5), (91, 3, None, 0.5, 0.5), (92, 3, 1, None, 0.5), (93, 3, 1, 0.5, None)]


def followed(data, before):
    """Chance of not being censored before a time (or until it): events go first at equal times."""
    chance = 1.0
    for t in sorted({d[1] for d in data}):
        if t < before:
            at_risk = sum(d[1] >= t for d in data) - sum(d[1] == t and d[2] == 1 for d in data)
            chance *= 1 - sum(d[1] == t and d[2] == 0 for d in data) / at_risk if at_risk else 1.0
    return chance


def concordance(data, s, w):
    pairs = [(a, b) for a in data for b in data if a[2] == 1 and (a[1] < b[1] or (a[1] == b[1] and b[2] == 0))]
    return sum(w[a[0]] * w[b[0]] * ((a[s] > b[s]) + (a[s] == b[s]) / 2) for a, b in pairs) / sum(w[a[0]] * w[b[0]] for a, b in pairs)


def state(data):
    cases = [(d, 1 / followed(data, d[1])) for d in data if d[2] == 1 and d[1] <= HORIZON]
    return cases, [(d, 1 / followed(data, HORIZON + 1)) for d in data if d[1] > HORIZON]


def auc(data, s, w):
    cases, controls = state(data)
    k = [(w[a[0]] * g * w[b[0]], (a[s] > b[s]) + (a[s] == b[s]) / 2) for a, g in cases for b, _ in controls]
    return sum(x * y for x, y in k) / sum(x for x, _ in k)


def brier(data, s, w):
    cases, controls = state(data)
    k = [(w[d[0]] * g, (d[s] - hit) ** 2) for part, hit in ((cases, 1), (controls, 0)) for d, g in part]
    return sum(x * y for x, y in k) / sum(x for x, _ in k)


@pytest.mark.parametrize("span", [1_000_000, 3])
@pytest.mark.parametrize("metric, plain, horizon", [(ev.bootstrap_cindex, concordance, ()), (ev.bootstrap_auc, auc, (HORIZON,)), (ev.bootstrap_brier, brier, (HORIZON,))])
def test_equals_every_pair(spark, monkeypatch, metric, plain, horizon, span):
    if span == 3 and metric is ev.bootstrap_brier:
        pytest.skip("no ranks")
    monkeypatch.setattr(ev, "WINDOW_SPAN", span)
    data = [r for r in rows() if None not in r]
    weights = [{d[0]: 1 for d in data}, *({d[0]: weight(d[0], r) for d in data} for r in range(REPS))]
    model, other = ([plain(data, s, w) for w in weights] for s in (3, 4))
    draws = sorted(m - c for m, c in zip(model[1:], other[1:]))
    df = spark.createDataFrame(rows(), "id INT, time INT, event INT, m DOUBLE, c DOUBLE").repartition(3)
    got = metric(df, "id", *horizon, "m", "c", reps=REPS, level=0.5).first()
    lo = int(0.25 * (REPS - 1))
    assert tuple(got) == pytest.approx((model[0], other[0], model[0] - other[0], draws[lo], draws[REPS - 1 - lo]))


def test_a_window_holds_fewer_scores_of_more_columns(spark, monkeypatch):
    """``WINDOW_SPAN`` numbers, not rows of a number for every replicate; the result is the same either way."""
    df = spark.createDataFrame(rows(), "id INT, time INT, event INT, m DOUBLE, c DOUBLE").repartition(3)
    whole, ranked = ev.bootstrap_auc(df, "id", HORIZON, "m", "c", reps=REPS, level=0.5).first(), []
    monkeypatch.setattr(ev, "WINDOW_SPAN", 100)  # above the 60 scores, below 60 times 8 weights
    monkeypatch.setattr(ev, "dense_ranks", lambda *a, made=ev.dense_ranks: ranked.append(a[1]) or made(*a))
    assert tuple(ev.bootstrap_auc(df, "id", HORIZON, "m", "c", reps=REPS, level=0.5).first()) == pytest.approx(tuple(whole))
    assert sorted(ranked) == ["c", "m"]


def test_score_equations_tell_a_maximum_from_another_point(spark):
    df = spark.createDataFrame([(1.0, 0.5, 2.0), (0.0, 0.5, 1.0), (1.0, 0.5, None), (None, 0.5, 1.0)], "y DOUBLE, p DOUBLE, x DOUBLE")
    from pyspark.sql import functions as F

    got = {r.term: r for r in models.score_equations(df, F.col("y"), F.col("p"), {"one": F.lit(1.0), "x": F.col("x"), "none": F.lit(0.0)}).collect()}
    assert (got["one"].n, got["one"].observed, got["one"].fitted, got["one"].is_met) == (3, 2.0, 1.5, 0)
    assert (got["x"].n, got["x"].observed, got["x"].gradient, got["x"].is_met) == (2, 2.0, 0.25, 0)
    assert got["none"].is_met == 1
    assert [(r.n, r.is_met) for r in models.score_equations(df.limit(0), F.col("y"), F.col("p"), {"one": F.lit(1.0)}).collect()] == [(0, None)]
